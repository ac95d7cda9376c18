"""Benchmark decontamination with a generalised suffix automaton of normalised test items.

Words are runs of ``[0-9a-z]`` and non-ASCII characters after lower-casing A-Z. A window is ``window``
consecutive words of an item; an item of fewer words, but not none, is one window. The automaton holds
every substring of every item; a document's words stream through it and the longest matching length is
tracked at each word, so every occurrence of every window is found in one pass.

Test items are read to the driver in chunks of ``chunk_words`` words and an automaton is built for each
and written to the shared folder, so what the driver and a worker hold is bounded; an item longer than a chunk is cut in
pieces that overlap by a window less one word. Documents are read once, whatever the size of the test set: a worker
takes a slice of them (larger ones where there are many automata) and lets one automaton after the other stream over it.

Nulls and other cases: a null or empty text has no words and no hits; a null or wordless item has no
windows; an item whose id is null still marks words as hit but is not among the items named; equal
item_ids name one item; repeated rows are all kept; an empty table of items leaves every document clean;
columns of other names are passed through by ``remove_passages`` and never read.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Bytes of words as they are in lower case, all others to a space.
WORD_BYTES = bytes(b if chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
WORD = re.compile(rb"[^ ]+")
#: Bytes of documents that are matched at once: with one automaton, and with several, which are read anew for each slice.
SLICE_BYTES, MANY_SLICE_BYTES = 4 << 20, 64 << 20


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class SuffixAutomaton:
    """All substrings of the items added, as sequences of words."""

    def __init__(self, window: int):
        self.window = window
        self.word_ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items: list[tuple[str | None, list[int]]] = []
        #: By state: windows that end there, longest first, as (words, item_ids).
        self.ends: list[tuple] = []
        self.shortest = window

    def add(self, item_id: str | None, words: list[bytes]) -> None:
        if not words:
            return
        ids = [self.word_ids.setdefault(w, len(self.word_ids)) for w in words]
        self.items.append((item_id, ids))
        self.shortest = min(self.shortest, len(ids))
        last = 0
        for c in ids:
            last = self._extend(last, c)

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(edges)
        return len(self.length) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """A state for the part of ``q`` that ends a longest match from ``p``."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:  # another item has this path
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return new

    def finish(self) -> SuffixAutomaton:
        own: dict[int, dict[int, set]] = {}
        for item_id, ids in self.items:
            most = min(self.window, len(ids))
            for end, (state, matched) in enumerate(self.run(ids), 1):
                if end >= most:
                    while self.length[self.link[state]] >= most:
                        state = self.link[state]
                    own.setdefault(state, {}).setdefault(most, set()).add(item_id)
        self.ends = [()] * len(self.length)
        for state in sorted(range(len(self.length)), key=self.length.__getitem__):
            above = self.ends[self.link[state]] if state else ()
            self.ends[state] = (*((m, frozenset(x)) for m, x in sorted(own.get(state, {}).items(), reverse=True)), *above)
        self.items = []
        return self

    def run(self, ids: list[int]) -> Iterator[tuple[int, int]]:
        """After each word: the state, and the length of the longest match that ends there."""
        state = matched = 0
        for c in ids:
            while state and c not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if (to := self.next[state].get(c)) is not None:
                state, matched = to, matched + 1
            yield state, matched

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Disjoint word ranges that windows cover, ascending, and the ids of the items with occurring windows."""
        ids = np.fromiter(map(self.word_ids.get, words, repeat(-1)), np.int32, len(words))
        spans: list[list[int]] = []
        items: set = set()
        edges = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False]))))
        for lo, hi in edges.reshape(-1, 2)[(edges[1::2] - edges[::2]) >= self.shortest].tolist():
            for at, (state, matched) in enumerate(self.run(ids[lo:hi].tolist()), lo + 1):
                longest = 0
                for m, named in self.ends[state]:
                    if m <= matched:
                        longest = longest or m
                        items |= named
                if longest:
                    start = at - longest
                    while spans and spans[-1][0] >= start:
                        spans.pop()
                    if spans and spans[-1][1] >= start:
                        spans[-1][1] = at
                    else:
                        spans.append([start, at])
        return [(a, b) for a, b in spans], items


def automata(benchmark: DataFrame, window: int, chunk_words: int, item_column: str = "item_id", text_column: str = "text") -> Iterator[SuffixAutomaton]:
    """Automata of all items, each of about ``chunk_words`` words at most."""
    one, held, most = SuffixAutomaton(window), 0, max(chunk_words, 2 * window)
    for item_id, text in benchmark.select(F.col(item_column).cast("string"), common.text_bytes(text_column)).toLocalIterator(prefetchPartitions=True):
        words = words_of(bytes(text))
        for lo in range(0, max(1, len(words) - window + 1), most - window + 1):
            piece = words[lo : lo + most]
            if held and held + len(piece) > chunk_words:
                yield one.finish()
                one, held = SuffixAutomaton(window), 0
            one.add(item_id, piece)
            held += len(piece)
    yield one.finish()


def _merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted([*a, *b]):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def _scanned(docs: DataFrame, benchmark: DataFrame, window: int, chunk_words: int, text_column: str, finish, schema: T.StructType) -> DataFrame:
    """What ``finish(batch, texts, rows)`` makes of the documents; a row is (spans, items, number of words).

    spans are the word ranges hit: start, end, start, end, ... One narrow pass over the documents.
    """
    spark, at, width = docs.sparkSession, docs.columns.index(text_column), len(docs.columns)
    where, n = common.new_dir(spark, "automata"), 0
    for one in automata(benchmark, window, chunk_words):
        common.put_file(f"{where}/{n:06d}", pickle.dumps(one, pickle.HIGHEST_PROTOCOL))
        n += 1

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = _automaton(where, 0) if n == 1 else None
        for batch in common.slices(batches, SLICE_BYTES if n == 1 else MANY_SLICE_BYTES):
            texts = [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]
            rows: list[tuple] = [([], set(), 0)] * len(texts)
            for k in range(n):
                each = one or _automaton(where, k)
                for i, text in enumerate(texts):
                    words = words_of(text)
                    spans, items = each.matches(words)
                    rows[i] = (_merged(rows[i][0], spans) if rows[i][0] and spans else spans or rows[i][0], rows[i][1] | items, len(words))
            own = pa.RecordBatch.from_arrays(batch.columns, [f"c{i}" for i in range(width)])
            yield finish(own, texts, [([x for s in spans for x in s], sorted(items - {None}), words) for spans, items, words in rows])

    return common.map_rows(docs, scan, schema)


def _automaton(where: str, k: int) -> SuffixAutomaton:
    system, path = common.filesystem(f"{where}/{k:06d}")
    with system.open_input_stream(path) as f:
        return pickle.loads(f.read())  # noqa: S301  what ``_scanned`` wrote


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, chunk_words: int = 200_000, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256 and contaminated. One narrow pass; no shuffle."""
    kept = docs.select(common.column(id_column).alias("doc_id"), common.column(text_column).cast("string").alias("text"))
    names = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    kinds = (T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.BooleanType())

    def finish(batch: pa.RecordBatch, texts: list[bytes], rows: list[tuple]) -> pa.RecordBatch:
        found = [(n, sum(s[1::2]) - sum(s[::2]), len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), bool(s)) for s, items, n in rows]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True))], ["doc_id", *names])

    return _scanned(kept, benchmark, window, chunk_words, "text", finish, T.StructType([kept.schema[0], *map(T.StructField, names, kinds)]))


def remove_passages(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, max_coverage: float = 0.5, min_span: int = 1, chunk_words: int = 200_000, text_column: str = "text") -> DataFrame:
    """The documents without the test passages in them, all columns kept.

    A document of whose words more than ``max_coverage`` are hit goes whole; from the others every hit
    span of at least ``min_span`` words is cut out of the text. Documents without hits stay as they are.
    """
    names, at = list(docs.columns), docs.columns.index(text_column)

    def finish(batch: pa.RecordBatch, texts: list[bytes], rows: list[tuple]) -> pa.RecordBatch:
        covered = [(sum(s[1::2]) - sum(s[::2])) > max_coverage * n for s, _, n in rows]
        keep = [i for i, (row, gone) in enumerate(zip(rows, covered, strict=True)) if not (row[0] and gone)]
        out = list(batch.columns)
        if any(rows[i][0] for i in keep):
            own = out[at].to_pylist()
            out[at] = pa.array([_without(texts[i], r[0], min_span) if r[0] else own[i] for i, r in enumerate(rows)], pa.string())
        return pa.RecordBatch.from_arrays([c.take(pa.array(keep, pa.int64())) for c in out] if len(keep) < len(rows) else out, names)

    return _scanned(docs, benchmark, window, chunk_words, text_column, finish, docs.schema)


def _without(data: bytes, span: list[int], min_span: int) -> str:
    at = [m.span() for m in WORD.finditer(data.translate(WORD_BYTES))]
    out, last = [], 0
    for a, b in zip(span[::2], span[1::2], strict=True):
        if b - a >= min_span:
            out.append(data[last : at[a][0]])
            last = at[b - 1][1]
    return b"".join([*out, data[last:]]).decode()
