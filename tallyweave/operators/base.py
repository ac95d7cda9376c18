"""What all sketches share: a relational state, its estimate, and merging by aggregating states again."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce, wraps
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession

from ..errors import EstimateUnavailableError, InvalidSketchParameterError, MergeTypeError, MergeUnsupportedError, SerializationError
from ..functions.hashing import derive
from ..sources.stream import Stream
from .codec import pack_table, unpack_table

CARDINALITY, QUANTILE, FREQUENCY, HEAVY_HITTERS = "cardinality", "quantile", "frequency", "heavy_hitters"


@dataclass(frozen=True)
class Query:
    """A question: its kind, and q, key or top_k where the kind has one."""

    kind: str
    q: float = 0.5
    key: int | None = None
    top_k: int = 10


@dataclass(frozen=True)
class MethodSpec:
    name: str
    tier: int
    query_types: tuple[str, ...]
    deterministic: bool
    mergeable: bool
    order_free: bool
    axis: str
    axis_range: tuple[int, int]


REGISTRY: dict[str, type[Sketch]] = {}

#: The key of a state's metadata, in its last column, that says which sketch made it. It outlives Parquet.
MADE_BY = "made_by"


def register(kind: type[Sketch]) -> type[Sketch]:
    """Make a sketch known by its name; again is harmless."""
    REGISTRY[kind.name] = kind
    return kind


class Sketch:
    """A summary of a stream with one size parameter.

    ``state`` is a DataFrame (rows of the summary beside the stream's ``by`` columns); where ``mergeable``,
    the union of states aggregated again is the state of the union of their streams. A state knows the name,
    size, seed and update rule of its sketch; another sketch neither merges nor reads it.
    """

    name: ClassVar[str]
    tier: ClassVar[int] = 1
    query_types: ClassVar[tuple[str, ...]]
    deterministic: ClassVar[bool] = True
    mergeable: ClassVar[bool] = False
    order_free: ClassVar[bool] = True
    axis: ClassVar[str]
    axis_range: ClassVar[tuple[int, int]]
    default: ClassVar[int]

    def __init_subclass__(cls, **options: object):
        """What ``state`` returns is labelled, and what ``lookup`` reads is checked, wherever a class defines them."""
        super().__init_subclass__(**options)
        if state := cls.__dict__.get("state"):
            cls.state = wraps(state)(lambda self, s: self.labelled(state(self, s)))
        if lookup := cls.__dict__.get("lookup"):
            cls.lookup = wraps(lookup)(lambda self, found, *a, **o: lookup(self, self.checked(found), *a, **o))

    def __init__(self, size: int | None = None, *, seed: int = 0):
        self.size = self.default if size is None else int(size)
        lo, hi = self.axis_range
        if not lo <= self.size <= hi:
            raise InvalidSketchParameterError(f"{self.axis} out of range", name=self.name, value=self.size, range=self.axis_range)
        self.seed = seed

    def __repr__(self) -> str:
        return f"{self.name}({self.axis}={self.size}, seed={self.seed})"

    def derived(self, tag: str) -> int:
        return derive(self.seed, tag)

    @classmethod
    def spec(cls) -> MethodSpec:
        return MethodSpec(cls.name, cls.tier, cls.query_types, cls.deterministic, cls.mergeable, cls.order_free, cls.axis, cls.axis_range)

    def label(self) -> str:
        return json.dumps({"name": self.name, "size": self.size, "seed": self.seed, "as_written": getattr(self, "as_written", False)}, sort_keys=True)

    def labelled(self, state: DataFrame) -> DataFrame:
        return state.withMetadata(state.columns[-1], {MADE_BY: self.label()})

    def checked(self, state: DataFrame) -> DataFrame:
        """The state, if this sketch made it; a MergeTypeError otherwise."""
        found = {f.metadata[MADE_BY] for f in state.schema.fields if MADE_BY in f.metadata}
        if found != {self.label()}:
            raise MergeTypeError("not a state of this sketch", sketch=self.label(), found=sorted(found))
        return state

    def merges(self) -> bool:
        """Whether this sketch's states merge, with its update rule."""
        return self.mergeable and not getattr(self, "as_written", False)

    def state(self, s: Stream) -> DataFrame:
        raise NotImplementedError

    def combine(self, state: DataFrame, by: tuple[str, ...]) -> DataFrame:
        """One state of the rows of several."""
        raise MergeUnsupportedError("this sketch does not merge", name=self.name)

    def union(self, states: list[DataFrame]) -> DataFrame:
        """The rows that ``combine`` takes."""
        return reduce(DataFrame.unionByName, states)

    def merge(self, *states: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
        """The state of all streams whose states these are, which must be of a sketch like this one."""
        if not self.merges():
            raise MergeUnsupportedError("this sketch does not merge", name=self.name)
        if not states:
            raise MergeTypeError("no states", name=self.name)
        return self.labelled(self.combine(self.union([self.checked(s) for s in states]), by))

    def serialize(self, state: DataFrame) -> bytes:
        """A state (bounded by the size parameter) as bytes."""
        return pack_table(self.name, {"label": self.label()}, self.checked(state).toArrow())

    def deserialize(self, payload: bytes, spark: SparkSession) -> DataFrame:
        """The state in what ``serialize`` of a sketch like this one returned."""
        name, meta, table = unpack_table(payload)
        if name != self.name or meta.get("label") != self.label():
            raise SerializationError("bytes of another sketch", expected=self.label(), found=meta.get("label", name))
        return self.labelled(spark.createDataFrame(table))

    @classmethod
    def slots(cls, size: int, keys: int) -> int:
        """Entries of the state's arrays, of eight bytes each or what is left; to describe, not to compare sketches."""
        return sum(-(-n // (8 * max(1, dims))) * max(1, dims) for _, dims, n in cls.fields(size, keys))

    def answer(self, state: DataFrame, query: Query, by: tuple[str, ...]) -> DataFrame:
        raise NotImplementedError

    def estimate(self, s: Stream | DataFrame, query: Query, by: tuple[str, ...] = ()) -> DataFrame:
        """The answer from a stream, or from a state with the given ``by`` columns."""
        if query.kind not in self.query_types:
            raise EstimateUnavailableError("this sketch answers other questions", name=self.name, asked=query.kind)
        return self.answer(self.state(s), query, s.by) if isinstance(s, Stream) else self.answer(self.checked(s), query, by)

    @classmethod
    def fields(cls, size: int, keys: int) -> list[tuple[str, int, int]]:
        """The arrays of the serialized state after ``keys`` distinct keys: name, dimensions, bytes."""
        raise NotImplementedError

    @classmethod
    def size_bytes(cls, size: int, keys: int) -> int:
        return wire_size(cls.name, cls.fields(size, keys), len(f'{{"{cls.axis}":{size}}}'))


def wire_size(name: str, arrays: list[tuple[str, int, int]], meta: int) -> int:
    """Bytes of a packed state (see ``codec``)."""
    return 4 + len(name) + 4 + meta + 2 + sum(1 + len(a) + 2 + 8 * dims + 8 + n for a, dims, n in arrays)


def discover(query_type: str | None = None, *, deterministic_only: bool = False, tier: int | None = None, keep: Callable[[MethodSpec], bool] = lambda _: True) -> list[MethodSpec]:
    """Registered methods by name that answer a question."""
    found = [k.spec() for _, k in sorted(REGISTRY.items())]
    return [m for m in found if (query_type is None or query_type in m.query_types) and (m.deterministic or not deterministic_only) and tier in (None, m.tier) and keep(m)]


def all_names() -> list[str]:
    return sorted(REGISTRY)


def spec_of(name: str) -> MethodSpec:
    if name not in REGISTRY:
        raise InvalidSketchParameterError("no such sketch", name=name, known=all_names())
    return REGISTRY[name].spec()
