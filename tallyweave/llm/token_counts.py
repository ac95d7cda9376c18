"""Token counts by the whole-token shortcut.

Offline, before any text is read, each string of the vocabulary is encoded alone by the library; those
that give one token are proven whole tokens. A text's pre-tokens that are among them count as one each
without any merging; only the rest are merged by the library. Counts of space-led chunks recur and are
kept in a bounded memo (see ``chunks``), so a chunk is cut into pre-tokens once.

The proof and the cutting hold for byte-level vocabularies. Others (``.json`` of another kind, ``.model``)
are counted by their library on whole texts.

Nulls and other cases: a null text is empty (0 bytes, 0 tokens); rows with equal ids are all kept; an
empty table gives an empty result; columns other than the two named are never read; texts of any length
are counted whole.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import common
from .chunks import Chunks, splits_at_spaces, tokenizer_of

#: Cuts a text into the byte-level pre-tokens (the published pattern of this family of vocabularies).
PRE_TOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def whole_tokens(tokenizer: Tokenizer) -> frozenset[str]:
    """The vocabulary's strings that the library encodes, each alone, as exactly one token and cuts into one pre-token."""
    strings = sorted({s for i in range(tokenizer.get_vocab_size()) if (s := tokenizer.decode([i], skip_special_tokens=False)) and "�" not in s})
    one = (s for s, e in zip(strings, tokenizer.encode_batch_fast(strings, add_special_tokens=False), strict=True) if len(e.ids) == 1)
    return frozenset(s for s in one if PRE_TOKENS.fullmatch(s) and PRE_TOKENS.findall(s) == [s])


def chunk_counts(tokenizer: Tokenizer, whole: frozenset[str]):
    """For Chunks: numbers of tokens of chunk texts."""
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def of(texts: list[str]) -> list[int]:
        counts, rest, owners = [0] * len(texts), [], []
        for i, text in enumerate(texts):
            # A special string inside a text is the library's to cut.
            for piece in [text] if any(a in text for a in added) else PRE_TOKENS.findall(text):
                if piece in whole:
                    counts[i] += 1
                else:
                    rest.append(piece)
                    owners.append(i)
        for i, found in zip(owners, tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            counts[i] += len(found)
        return counts

    return of


def _memo(data: bytes, whole: frozenset[str]) -> Chunks:
    """A worker's memo, which outlives the task."""
    return common.kept_memo(("counts", zlib.crc32(data)), lambda: Chunks(chunk_counts(tokenizer_of(data), whole), sum))


def _library_counts(data: bytes, kind: str):
    if kind == "model":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=data)
        return lambda texts: map(len, model.encode(texts, num_threads=1))
    return lambda texts: map(len, tokenizer_of(data).encode_batch_fast(texts, add_special_tokens=False))


def token_counts(docs: DataFrame, tokenizer_path: str, *, limit: int = 512, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes (UTF-8), n_tokens as the vocabulary's library counts, over_limit (n_tokens > limit).

    One narrow pass over the texts; no shuffle.
    """
    with open(tokenizer_path, "rb") as f:
        data = f.read()
    kind = tokenizer_path.rsplit(".", 1)[-1]
    by_chunks = kind == "json" and splits_at_spaces(json.loads(data))
    held = docs.sparkSession.sparkContext.broadcast((data, whole_tokens(tokenizer_of(data)) if by_chunks else None))  # a vocabulary: a few MB whatever the corpus

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, whole = held.value
        totals = _memo(data, whole).totals if by_chunks else lambda texts, f=_library_counts(data, kind): f([t.decode("utf-8", "replace") for t in texts])
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = list(totals(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kept = docs.select(F.col(id_column).cast("long").alias("doc_id"), common.text_bytes(text_column).alias("text"))
    return kept.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
