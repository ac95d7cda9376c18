"""Language identification with language-bitmask n-gram filters.

Training counts byte trigrams (of lower-cased text between spaces) by language over all labelled
training documents. A trigram belongs to each language in which its rate is at least ``rho`` of its
highest rate in any language. A bit-sliced Bloom filter holds, at each position, one bit for each
language: the AND of the words at a trigram's ``hashes`` positions is the set of all languages that
contain it. A text's score for a language is the popcount of its bit over the text's trigrams, as a
share p of them, corrected for the filter's false positives f of that language: (p - f) / (1 - f).

The filter is built by Spark as (position, bits) rows and has at most ``2**24`` positions, so what
is collected and broadcast is bounded whatever the corpus; more than 64 languages take more slices. There are 16 positions
or more for each trigram. Where that would take more than there are trigrams at all, ``2**24``, a trigram's own
number is its only position and nothing is false: the filter never fills up.

Nulls and other cases: a text that is null or has no letter is ``und`` with score 0, as is every text
if no language was learned; rows with null lang don't train; a text none of whose trigrams is known
gets the language with the most training bytes; ties go to the first language by code point; repeated
rows are all kept and all count; other columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Bytes of text that are counted or scored at once.
SLICE_BYTES = 4 << 20
EVERY_TRIGRAM = 1 << 24
#: Positions for each trigram that is held, at least.
_SPARE = 16
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
_MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646C)


def _codes(data: bytes) -> np.ndarray:
    """The trigram that starts at each byte but the last two."""
    x = np.frombuffer(data, np.uint8).astype(np.uint32)
    return (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]


def _has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "replace"))


def trigram_counts(docs: DataFrame, train: Column, lang_column: str, text_column: str) -> DataFrame:
    """(lang, gram, n) over the training rows; each task adds up its own before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[bytes]] = {}
        found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def add(lang: str) -> None:
            n = np.bincount(_codes(b" ".join([b"", *waiting.pop(lang), b""]).translate(common.LOWER)), minlength=0)
            at = np.flatnonzero(n)
            found.setdefault(lang, []).append((at, n[at]))

        for langs, texts in common.table_rows(batches):
            sizes: dict[str, int] = {k: sum(map(len, v)) for k, v in waiting.items()}
            for lang, text in zip(langs, texts, strict=True):
                waiting.setdefault(lang, []).append(text)
                sizes[lang] = sizes.get(lang, 0) + len(text)
                if sizes[lang] >= SLICE_BYTES:
                    add(lang)
                    sizes[lang] = 0
        for lang in list(waiting):
            add(lang)
        for lang, parts in found.items():
            grams, where = np.unique(np.concatenate([a for a, _ in parts]), return_inverse=True)
            n = np.bincount(where, np.concatenate([b for _, b in parts]), len(grams)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int32)), pa.array(n)], ["lang", "gram", "n"])

    kept = docs.where(train & F.col(lang_column).isNotNull() & F.col(text_column).isNotNull())
    parts = kept.select(F.col(lang_column).cast("string").alias("lang"), common.text_bytes(text_column).alias("text")).mapInArrow(count, "lang string, gram int, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class LanguageFilter:
    """The bit-sliced filter: ``slices[s][position]`` has bit l for language 64 s + l."""

    def __init__(self, languages: list[str], positions: int, hashes: int, fallback: int):
        self.languages, self.hashes, self.fallback = languages, hashes, fallback
        self.own_places = positions >= EVERY_TRIGRAM
        self.bits = positions.bit_length() - 1
        self.slices = np.zeros((max(1, -(-len(languages) // 64)), positions), np.uint64)

    def positions(self, codes: np.ndarray) -> Iterator[np.ndarray]:
        if self.own_places:
            yield codes
            return
        for m in _MULTIPLIERS[: self.hashes]:
            h = codes * np.uint32(m)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            yield h >> np.uint32(32 - self.bits)

    def finish(self) -> LanguageFilter:
        fill = np.array([float(((self.slices[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) for i in range(len(self.languages))])
        self.false_rate = np.zeros(len(fill)) if self.own_places else fill**self.hashes
        return self

    def lookup(self, codes: np.ndarray) -> np.ndarray:
        """By slice, the languages of each trigram."""
        out = None
        for at in self.positions(codes):
            found = self.slices[:, at]
            out = found if out is None else out & found
        return out

    def shares(self, texts: list[bytes]) -> np.ndarray:
        """Per text (none empty) and language, the corrected share of its trigrams."""
        data = b"".join(b" %b " % t for t in texts).translate(common.LOWER)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths + 2)
        at = np.stack([ends - lengths - 2, ends - 2], 1).ravel()
        at = np.minimum(at, len(data) - 3)
        masks = self.lookup(_codes(data))
        last = np.arange(len(texts)) == len(texts) - 1
        out = np.empty((len(texts), len(self.languages)))
        for i in range(len(self.languages)):
            bit = ((masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).astype(np.int64)
            n = np.add.reduceat(bit, at)[::2]
            # The last text's trigrams run to the end of the array, which reduceat cuts one short.
            n = np.where(last, bit[at[-2] :].sum(), n)
            out[:, i] = n / lengths
        return np.clip((out - self.false_rate) / np.maximum(1 - self.false_rate, 1e-12), 0, 1)


def learn_languages(docs: DataFrame, train: Column, *, rho: float = 0.4, hashes: int = 4, lang_column: str = "lang", text_column: str = "text") -> LanguageFilter:
    """Fit the filter on the rows where ``train`` holds, all of them whole."""
    counts = common.materialize(trigram_counts(docs, train, lang_column, text_column), "trigrams")
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # one row a language
    languages = sorted(totals)
    if not languages:
        return LanguageFilter([], 2, hashes, 0).finish()
    n_grams = counts.select("gram").distinct().count()
    size = min(EVERY_TRIGRAM, max(1 << 12, 1 << (_SPARE * n_grams - 1).bit_length()))
    out = LanguageFilter(languages, size, hashes, max(range(len(languages)), key=lambda i: (totals[languages[i]], -i)))
    spark = docs.sparkSession
    table = spark.createDataFrame([(x, i, float(totals[x])) for i, x in enumerate(languages)], "lang string, i int, total double")
    rates = counts.join(F.broadcast(table), "lang").select("gram", "i", (F.col("n") / F.col("total")).alias("rate"))
    best = F.max("rate").over(Window.partitionBy("gram"))  # at most one row a language
    member = rates.withColumn("best", best).where(F.col("rate") >= rho * F.col("best"))
    grams = member.groupBy("gram", F.floor(F.col("i") / 64).cast("int").alias("slice")).agg(F.bit_or(F.expr("shiftleft(1L, i % 64)")).alias("mask"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(0).to_numpy().astype(np.uint32)
            for at in out.positions(codes):
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), batch.column(1), batch.column(2)], ["at", "slice", "mask"])

    placed = grams.mapInArrow(place, "at int, slice int, mask long").groupBy("at", "slice").agg(F.bit_or("mask").alias("mask"))
    found = placed.toArrow()  # at most one row a position and slice
    out.slices[found["slice"].to_numpy(), found["at"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
    return out.finish()


def identify(docs: DataFrame, model: LanguageFilter, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: doc_id, lang_pred and score. One narrow pass."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most 2**24 positions

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = held.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            langs, scores, lo = ["und"] * len(texts), [0.0] * len(texts), 0
            while lo < len(texts) and one.languages:
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size < SLICE_BYTES):
                    size += len(texts[hi])
                    hi += 1
                at = [i for i in range(lo, hi) if _has_letter(texts[i])]
                if at:
                    shares = one.shares([texts[i] for i in at])
                    total = shares.sum(1)
                    best = np.where(total > 0, shares.argmax(1), one.fallback)
                    own = np.where(total > 0, shares[np.arange(len(at)), best] / np.maximum(total, 1e-300), 0.0)
                    for i, b, s in zip(at, best.tolist(), own.tolist(), strict=True):
                        langs[i], scores[i] = one.languages[b], s
                lo = hi
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    kept = docs.select(F.col(id_column).cast("long").alias("doc_id"), common.text_bytes(text_column).alias("text"))
    return kept.mapInArrow(score, "doc_id long, lang_pred string, score double")
