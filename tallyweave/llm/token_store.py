"""Token-ID output: flat unsigned integer files with 64-bit document offsets, written in order and memory-mapped.

A store is a folder of shards, one for each range of documents in ascending ``doc_id`` order, and a
manifest. Shard ``i`` is two flat little-endian files:

- ``i.ids``: the ids of its documents, end id included, as 16-bit unsigned integers if every id of the
  vocabulary fits, else 32-bit;
- ``i.idx``: the doc_ids as int64 (n of them), then n + 1 uint64 offsets into ``i.ids`` counted from the shard's start.

The manifest holds each shard's documents, ids and its bases: the numbers of documents and ids in all
shards before it, which are prefix sums of the counts that the writing tasks return (one row a shard).
Any document can then be found by two seeks without reading other shards.

There is a shard for each ``SHARD_BYTES`` of text, whatever the session's settings. A task streams ids to
its file as they come and keeps 16 bytes a document for the index, so its memory does not grow with the ids.

Nulls and other cases: a null text counts as empty and holds the end id alone; null doc_ids come first
(the manifest counts them); rows with equal doc_id are all kept, ordered by a hash of their text; an
empty table makes a store without shards. Columns other than the two named are never read.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .chunks import Chunks, id_memo, packed, splits_at_spaces, tokenizer_of

SHARD_BYTES = 16 << 20


def _memo(data: bytes, code: str) -> Chunks:
    """A worker's memo, which outlives the task."""
    return common.kept_memo(("ids", zlib.crc32(data), code), lambda: id_memo(tokenizer_of(data), code))


@dataclass(frozen=True)
class TokenStore:
    """A written store: its folder, the ids' width and the manifest's shards in order."""

    uri: str
    bits: int
    shards: list[dict]

    @property
    def dtype(self) -> str:
        return f"<u{self.bits // 8}"

    @classmethod
    def open(cls, uri: str) -> TokenStore:
        system, path = common.filesystem(f"{uri}/manifest.json")
        with system.open_input_stream(path) as f:
            head = json.loads(f.read())
        return cls(uri, head["bits"], head["shards"])

    def documents(self, spark: SparkSession, reader=None, schema: str = "doc_id long, start long, n_tokens long, ids_crc32 long") -> DataFrame:
        """One row per document as read back from the files; ``reader`` turns a mapped shard into a record batch."""
        rows = [(i, s["shard"], s["documents"], s["null_ids"], s["id_base"]) for i, s in enumerate(self.shards)]
        if not rows:
            return spark.createDataFrame([], schema)
        uri, dtype, make = self.uri, self.dtype, reader or _digest
        frame = spark.createDataFrame(rows, "task int, shard int, documents long, null_ids long, id_base long").repartitionById(len(rows), "task")

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, shards, documents, nulls, bases in common.table_rows(batches):
                for shard in zip(shards, documents, nulls, bases, strict=True):
                    yield from make(uri, dtype, *shard)

        return frame.mapInArrow(read, schema)


def _mapped(uri: str, dtype: str) -> np.ndarray:
    """A file's integers: memory-mapped where the folder is mounted, else fetched."""
    system, path = common.filesystem(uri)
    if system.type_name == "local":
        return np.memmap(path, dtype, "r") if system.get_file_info(path).size else np.empty(0, dtype)
    with system.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def shard_arrays(uri: str, dtype: str, shard: int, documents: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A shard's ids, doc_ids and offsets (documents + 1 of them)."""
    index = _mapped(f"{uri}/{shard:06d}.idx", "<i8")
    return _mapped(f"{uri}/{shard:06d}.ids", dtype), index[:documents], index[documents:].view("<u8")


def _digest(uri: str, dtype: str, shard: int, documents: int, null_ids: int, base: int) -> Iterator[pa.RecordBatch]:
    ids, doc_ids, offsets = shard_arrays(uri, dtype, shard, documents)
    for lo in range(0, documents, 10_000):
        hi = min(documents, lo + 10_000)
        cuts = offsets[lo : hi + 1].astype(np.int64)
        crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        no_id = np.arange(lo, hi) < null_ids
        yield pa.RecordBatch.from_arrays([pa.array(doc_ids[lo:hi], mask=no_id), pa.array(cuts[:-1] + base), pa.array(np.diff(cuts)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def write_token_store(docs: DataFrame, tokenizer_path: str, uri: str, *, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text", shards: int | None = None) -> TokenStore:
    """Encode every whole text, append ``end_id`` to each and write the store in ascending order of the id column.

    One range shuffle orders the texts; each task then encodes and writes its own range. The driver
    receives one row of counts for each shard.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as f:
        data = f.read()
    vocabulary = tokenizer_of(data)
    largest = max([end_id, *vocabulary.get_vocab().values()])
    code, bits = ("H", 16) if largest < 1 << 16 else ("I", 32)
    by_chunks = splits_at_spaces(json.loads(data))
    held = spark.sparkContext.broadcast(data)  # a vocabulary file: a few MB whatever the corpus
    end = packed([end_id], code)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        one = _memo(held.value, code)
        doc_ids, offsets, nulls = array("q"), array("Q", [0]), 0
        rows = common.table_rows(common.pieces(batches))
        if (first := next(rows, None)) is None:
            return
        with common.new_file(f"{uri}/{shard:06d}.ids") as out:
            for keys, texts in chain([first], rows):
                for key, found in zip(keys, one.totals(texts) if by_chunks else one.of([t.decode("utf-8", "replace") for t in texts]), strict=True):
                    out.write(found)
                    out.write(end)
                    nulls += key is None
                    doc_ids.append(key or 0)
                    offsets.append(offsets[-1] + len(found) // (bits // 8) + 1)
        with common.new_file(f"{uri}/{shard:06d}.idx") as out:
            out.write(np.frombuffer(doc_ids, np.int64).astype("<i8"))
            out.write(np.frombuffer(offsets, np.uint64).astype("<u8"))
        yield pa.RecordBatch.from_pylist([{"shard": shard, "documents": len(doc_ids), "null_ids": nulls, "ids": offsets[-1]}], pa.schema([("shard", pa.int32()), ("documents", pa.int64()), ("null_ids", pa.int64()), ("ids", pa.int64())]))

    n_bytes = docs.agg(F.sum(F.octet_length(F.col(text_column).cast("string")))).first()[0] or 0
    n = shards or max(1, -(-n_bytes // SHARD_BYTES))
    texts = docs.select(F.col(id_column).cast("long").alias("k"), common.text_bytes(text_column).alias("t"))
    order = [F.col("k").asc_nulls_first(), F.xxhash64("t")]
    counts = texts.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(write, "shard int, documents long, null_ids long, ids long").collect()
    found, documents, total = [], 0, 0
    for row in sorted(counts):
        found.append(row.asDict() | {"document_base": documents, "id_base": total})
        documents, total = documents + row.documents, total + row.ids
    common.put_file(f"{uri}/manifest.json", json.dumps({"bits": bits, "end_id": end_id, "documents": documents, "ids": total, "shards": found}).encode())
    return TokenStore(uri, bits, found)


def token_output(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write a store in the shared folder and return each document's start, length and checksum from its files."""
    spark = docs.sparkSession
    store = write_token_store(docs, tokenizer_path, common.new_dir(spark, "tokens"), **options)
    return TokenStore.open(store.uri).documents(spark)
