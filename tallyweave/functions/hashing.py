"""64-bit mixing hashes: the same values on the driver, in NumPy and inside Spark's generated code.

``hashed`` adds the hash as a BIGINT (the unsigned value's bits) without leaving the JVM and without
touching the session's ANSI setting: 64-bit products and sums are made of 16- and 32-bit parts that never
overflow, and each step is a projection of its own that reads the one before many times, which keeps the
optimizer from merging them into one exponentially large expression.
"""

from __future__ import annotations

import math
import random
import struct
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidConfigError, MissingSeedError

#: Constants of the published SplitMix64 generator. Fixed values.
GAMMA = 0x9E3779B97F4A7C15
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB
MASK = (1 << 64) - 1


def derive(root: int, tag: str) -> int:
    """A seed for one purpose from the root seed."""
    return int.from_bytes(blake2b(f"{root}:{tag}".encode(), digest_size=8).digest(), "little")


@dataclass(frozen=True)
class Seed:
    """A root seed, from which every purpose has its own."""

    root: int

    def derive(self, tag: str) -> int:
        return derive(self.root, tag)

    def generators(self, n: int) -> list[np.random.Generator]:
        """Independent NumPy generators."""
        if n < 0:
            raise InvalidConfigError("a number of generators is not negative", n=n)
        return [np.random.default_rng(s) for s in np.random.SeedSequence(self.root).spawn(n)]


_root: list[Seed] = []


def set_seed(root: int) -> Seed:
    """The process's root seed; Python's and NumPy's global generators start from it too."""
    if not isinstance(root, int) or isinstance(root, bool):
        raise InvalidConfigError("a seed is an integer", type=type(root).__name__)
    random.seed(root)
    np.random.seed(root % (1 << 32))
    _root[:] = [Seed(root)]
    return _root[0]


def required_seed() -> Seed:
    if not _root:
        raise MissingSeedError("set_seed(root) comes first")
    return _root[0]


def splitmix64(x: int) -> int:
    x = (x + GAMMA) & MASK
    x = ((x ^ (x >> 30)) * MIX_1) & MASK
    x = ((x ^ (x >> 27)) * MIX_2) & MASK
    return x ^ (x >> 31)


def stable_key(item: object) -> bytes:
    """An item as bytes that are the same in every process; equal numbers of a type give equal bytes."""
    if isinstance(item, (bytes, bytearray)):
        return bytes(item)
    if isinstance(item, str):
        return item.encode()
    if isinstance(item, (bool, int, np.integer, np.bool_)):
        return (int(item) & MASK).to_bytes(8, "little")
    if isinstance(item, (float, np.floating)):
        x = float(item)
        return struct.pack("<d", math.nan if x != x else x + 0.0)
    raise TypeError(f"no stable key for {type(item).__name__}")


def hash_u64(key: bytes, seed: int) -> int:
    """The hash of a key's bytes; up to 8 bytes are one word, longer keys are chained words."""
    if len(key) <= 8:
        return splitmix64(int.from_bytes(key, "little") ^ (seed & MASK))
    state = len(key)
    for i in range(0, len(key), 8):
        state = splitmix64(state ^ int.from_bytes(key[i : i + 8], "little"))
    return splitmix64(state ^ (seed & MASK))


def hash_index(key: bytes, seed: int, width: int) -> int:
    if width <= 0:
        raise ValueError("width must be positive")
    return hash_u64(key, seed) % width


def hash_sign(key: bytes, seed: int) -> int:
    return 1 if hash_u64(key, seed) & 1 else -1


def hash_array_u64(items: np.ndarray, seed: int) -> np.ndarray:
    """``hash_u64`` of an array of integers, booleans or floats."""
    items = np.asarray(items)
    if items.dtype.kind in "iub":
        x = items.astype(np.int64).view(np.uint64) if items.dtype.kind != "u" else items.astype(np.uint64)
    elif items.dtype.kind == "f":
        x = np.where(np.isnan(items), np.nan, items.astype(np.float64) + 0.0).astype(np.float64).view(np.uint64)
    else:
        raise TypeError(f"no array hash for {items.dtype}")
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(seed & MASK)) + np.uint64(GAMMA)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_1)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_2)
    return x ^ (x >> np.uint64(31))


def bit_length_u64(x: int) -> int:
    return int(x).bit_length()


def signed(x: int) -> int:
    """The BIGINT with an unsigned value's bits."""
    x &= MASK
    return x - (1 << 64) if x >> 63 else x


# --- in Spark ---

_LOW32 = (1 << 32) - 1


def _shift(c: Column, n: int) -> Column:
    return F.shiftrightunsigned(c, n)


def _and(c: Column, mask: int) -> Column:
    return c.bitwiseAND(F.lit(mask).cast("long"))


def _join(high: Column, low: Column) -> Column:
    return F.shiftleft(high, 32).bitwiseOR(low)


def _plus(x: Column, k: int) -> Column:
    """x + k modulo 2**64."""
    low = _and(x, _LOW32) + F.lit(k & _LOW32)
    high = _shift(x, 32) + F.lit(k >> 32) + _shift(low, 32)
    return _join(_and(high, _LOW32), _and(low, _LOW32))


def _times(x: Column, k: int) -> Column:
    """x * k modulo 2**64."""
    k0, k1 = F.lit(k & _LOW32), F.lit(k >> 32)
    a0, a1 = _and(x, 0xFFFF), _and(_shift(x, 16), 0xFFFF)
    a2, a3 = _and(_shift(x, 32), 0xFFFF), _shift(x, 48)
    p0, p1 = a0 * k0, a1 * k0
    low = _and(p0, _LOW32) + F.shiftleft(_and(p1, 0xFFFF), 16)
    part = lambda a, b, k: _and(a * k, _LOW32) + F.shiftleft(_and(b * k, 0xFFFF), 16)
    high = _shift(p0, 32) + _shift(p1, 16) + _shift(low, 32) + part(a2, a3, k0) + part(a0, a1, k1)
    return _join(_and(high, _LOW32), _and(low, _LOW32))


def _fold(x: Column, n: int) -> Column:
    return x.bitwiseXOR(_shift(x, n))


def hashed(df: DataFrame, key: str, seed: int, name: str) -> DataFrame:
    """``df`` with ``name``: the hash of a key as BIGINT, as ``hash_u64`` gives it for ``stable_key``; null for a null key.

    Integers and booleans stay in generated code. Texts, bytes and floats, whose bits Spark SQL doesn't give, are hashed
    in NumPy, an Arrow batch at a time.
    """
    kind = dict(df.dtypes)[key]
    if kind in ("string", "binary", "float", "double"):
        return _hashed_in_batches(df, key, seed, name)
    if kind not in ("boolean", "tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"no hash for keys of type {kind}")
    held = [f"{name}_{i}" for i in range(3)]
    out = df.withColumn(held[0], _plus(F.col(key).cast("long").bitwiseXOR(F.lit(signed(seed))), GAMMA))
    out = out.withColumn(held[1], _fold(F.col(held[0]), 30)).withColumn(held[2], _times(F.col(held[1]), MIX_1))
    out = out.withColumn(held[0], _fold(F.col(held[2]), 27)).withColumn(held[1], _times(F.col(held[0]), MIX_2))
    return out.withColumn(name, _fold(F.col(held[1]), 31)).drop(*held)


def hash_bytes_u64(keys: list[bytes], seed: int) -> np.ndarray:
    """``hash_u64`` of many keys, word by word over those that are long enough."""
    lengths = np.fromiter(map(len, keys), np.int64, len(keys))
    words = (lengths + 7) // 8
    starts = np.cumsum(words) - words
    packed = np.frombuffer(b"".join(k.ljust(8 * int(w), b"\0") for k, w in zip(keys, words, strict=True)), "<u8").astype(np.uint64)
    first = np.zeros(len(keys), np.uint64)
    first[words > 0] = packed[starts[words > 0]]
    state = np.where(lengths > 8, lengths.astype(np.uint64), first)
    for i in range(int(words.max(initial=0))):
        at = np.flatnonzero((words > i) & (lengths > 8))
        if not len(at):
            break
        state[at] = hash_array_u64(state[at] ^ packed[starts[at] + i], 0)
    return hash_array_u64(state, seed)


def _hashed_in_batches(df: DataFrame, key: str, seed: int, name: str) -> DataFrame:
    import pyarrow as pa

    at, schema = df.columns.index(key), T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])

    def add(batches):
        for batch in batches:
            column = batch.column(at)
            if pa.types.is_floating(column.type):
                h = hash_array_u64(column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64), seed)
            else:
                h = hash_bytes_u64([x or b"" for x in column.cast(pa.binary()).to_pylist()], seed)
            found = pa.array(h.view(np.int64), mask=column.is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [f"c{i}" for i in range(len(schema))])

    plain = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(schema)])
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(add, plain).toDF(*schema.names)


def unsigned_order(h: str | Column) -> Column:
    """A column that sorts as the unsigned hash does."""
    return (F.col(h) if isinstance(h, str) else h).bitwiseXOR(F.lit(-(1 << 63)))


def unsigned_value(h: str | Column) -> Column:
    """The unsigned hash as DOUBLE."""
    c = F.col(h) if isinstance(h, str) else h
    wide = c.cast("decimal(20,0)")
    return F.when(c < 0, wide + F.expr("18446744073709551616BD")).otherwise(wide).cast("double")


def bit_length(c: Column) -> Column:
    """Bits of an unsigned BIGINT without leading zeros, by the exponents of its halves, which doubles hold exactly."""
    half = lambda x, more: F.floor(F.log2(x.cast("double") + 0.5)).cast("int") + 1 + more
    high = F.shiftrightunsigned(c, 32)
    return F.when(high != 0, half(high, 32)).when(c != 0, half(c.bitwiseAND(F.lit(_LOW32)), 0)).otherwise(0)
