"""Toxicity: a linear-chain conditional random field tags toxic words; its marginals score documents.

Words are runs of ``[0-9a-z]`` and non-ASCII characters after lower-casing A-Z. A word's emission is the
sum of the learned weights of the word, its first 3, 4 and 5 and its last 3 bytes; two states (clean,
toxic) are linked by learned transitions along the whole document. Forward-backward odds give each
word's marginal, the offending spans are the runs of words whose marginal is at least one half, and the
document's score is a logistic function of the highest marginal and of the expected number of toxic words.

Labels come by document, so words are labelled first by the features that toxic documents have far more
often than clean ones, then twice anew by the field's own marginals inside toxic documents.

The field is fitted on a bounded sample of labelled rows, at most ``MOST_TOXIC`` and ``MOST_CLEAN`` of
them (the first of each label by a hash of their id) and of these whole texts of ``MOST_BYTES`` in all, by the same
hash; every document is then scored whole.

Nulls and other cases: a null or empty text has no words and gets the score of a document without
evidence; labels that are null, or whose document isn't there, teach nothing; a document labelled twice
counts as toxic if any label says so; without documents of both labels every score is 0; repeated rows
are all kept; an empty table gives an empty result; other columns are never read or are passed through.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .decontaminate import WORD, WORD_BYTES, words_of

#: Labelled documents that the field is fitted on, at most.
MOST_TOXIC, MOST_CLEAN = 1_000, 2_000
MOST_BYTES = 32 << 20
#: Words whose emissions a worker remembers, and bytes of text scored at once.
MEMO_WORDS = 300_000
SLICE_BYTES = 4 << 20
#: What stands for a document without words: logit of its highest marginal, expected toxic words.
NO_LOGIT, NO_WORDS = -12.0, 1e-6


def features(word: bytes) -> tuple[bytes, ...]:
    return (b"w" + word, b"3" + word[:3], b"4" + word[:4], b"5" + word[:5], b"e" + word[-3:])


def chain_odds(emission: np.ndarray, lengths: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward odds (toxic to clean) of every word of several documents laid end to end.

    ``transition``: factors from clean to toxic, toxic to clean and toxic to toxic (clean to clean is 1).
    """
    into, out, stay = transition
    order = np.argsort(-lengths, kind="stable")
    sizes = lengths[order]
    starts = (np.cumsum(lengths) - lengths)[order]
    factor = np.exp(np.clip(emission, -30, 30))
    forward, backward = np.empty_like(factor), np.ones_like(factor)
    # Documents longer than t, for each t: they are the first ones in order.
    longer = len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes[0] if len(sizes) else 0), "right")
    odds = np.zeros(len(sizes))
    for t, n in enumerate(longer.tolist()):
        at = starts[:n] + t
        odds = odds[:n]
        odds = factor[at] * (into if t == 0 else (into + stay * odds) / (1 + out * odds))
        forward[at] = odds
    odds = np.ones(0)
    for t in range(len(longer) - 1, 0, -1):
        n = int(longer[t])
        if len(odds) < n:
            odds = np.concatenate([odds, np.ones(n - len(odds))])
        x = factor[starts[:n] + t] * odds
        odds = (out + stay * x) / (1 + into * x)
        backward[starts[:n] + t - 1] = odds
    return forward, backward


class ToxicSpans:
    """The fitted field and the document score on top of it."""

    def __init__(self, weights: dict[bytes, float], bias: float, transition: np.ndarray, scale: np.ndarray):
        self.weights, self.bias, self.transition, self.scale = weights, bias, transition, scale

    def emission(self, word: bytes) -> float:
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in features(word))

    def document_scores(self, top: np.ndarray, expected: np.ndarray) -> np.ndarray:
        a, b, c = self.scale
        return 1 / (1 + np.exp(-np.clip(a + b * top + c * np.log(np.maximum(expected, NO_WORDS)), -30, 30)))


def _evidence(odds: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By document: the logit of its highest marginal, and its expected number of toxic words."""
    top, expected = np.full(len(lengths), NO_LOGIT), np.full(len(lengths), NO_WORDS)
    some = np.flatnonzero(lengths)
    if len(some):
        at = (np.cumsum(lengths) - lengths)[some]
        top[some] = np.clip(np.log(np.maximum.reduceat(odds, at)), NO_LOGIT, -NO_LOGIT)
        expected[some] = np.add.reduceat(odds / (1 + odds), at)
    return top, expected


def _ascend(step, parameters: np.ndarray, rounds: int, rate: float) -> np.ndarray:
    """Adam."""
    m, v = np.zeros_like(parameters), np.zeros_like(parameters)
    for t in range(1, rounds + 1):
        g = step(parameters)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        parameters = parameters + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return parameters


def fit(texts: list[bytes], toxic: np.ndarray, *, relabel: int = 2, rounds: int = 30, ridge: float = 2e-3) -> ToxicSpans | None:
    """The field fitted on labelled documents; None without documents of both labels."""
    toxic = toxic.astype(bool)
    if toxic.all() or not toxic.any():
        return None
    ids: dict[bytes, int] = {}
    documents = []
    in_toxic: Counter = Counter()
    for text, y in zip(texts, toxic, strict=True):
        words = words_of(text)
        documents.append(np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int32, len(words)))
        if y:
            in_toxic.update({f for w in set(words) for f in features(w)})
    lengths = np.fromiter(map(len, documents), np.int64, len(documents))
    tokens = np.concatenate(documents)
    # Features of at least two toxic documents; what only clean ones hold is left to the bias.
    names = {f: i for i, f in enumerate(sorted(f for f, n in in_toxic.items() if n >= 2))}
    none = len(names)
    table = np.fromiter((names.get(f, none) for w in ids for f in features(w)), np.int32, 5 * len(ids)).reshape(-1, 5)
    toxic_counts, clean_counts = np.array([in_toxic[f] for f in names], np.int64), np.zeros(none + 1, np.int64)
    del in_toxic
    for document, y in zip(documents, toxic, strict=True):
        if not y:
            clean_counts[np.unique(table[np.unique(document)])] += 1
    n_toxic, n_clean = int(toxic.sum()), int((~toxic).sum())
    odds_ratio = np.log((toxic_counts + 0.5) / (n_toxic + 1)) - np.log((clean_counts[:none] + 0.5) / (n_clean + 1))
    telling = np.append((odds_ratio >= 3) & (toxic_counts >= 3), False)
    inside = np.repeat(toxic, lengths)
    labels = telling[table].any(1)[tokens] & inside
    starts = np.cumsum(lengths) - lengths
    linked = np.ones(len(tokens), bool)  # a word has one after it in its document
    linked[starts[lengths > 0] + lengths[lengths > 0] - 1] = False
    before = np.flatnonzero(linked)
    # Weights of features, one for none, bias, then the logs of the transition factors.
    parameters = np.zeros(none + 5)
    parameters[none + 1], parameters[none + 2 :] = -5.0, (-1.0, 1.0, 0.0)
    weigh = np.full(len(tokens), 100 / len(tokens))

    def emissions(p: np.ndarray) -> np.ndarray:
        by_word = p[:none].tolist() and np.append(p[:none], 0.0)[table].sum(1) + p[none + 1]
        return np.asarray(by_word)[tokens]

    def odds_of(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e = emissions(p)
        forward, backward = chain_odds(e, lengths, np.exp(p[none + 2 :]))
        return e, forward, backward

    def step(p: np.ndarray) -> np.ndarray:
        e, forward, backward = odds_of(p)
        marginal = forward * backward / (1 + forward * backward)
        g = np.zeros_like(p)
        miss = (labels - marginal) * weigh
        by_word = np.bincount(tokens, miss, len(ids))
        g[: none + 1] = np.bincount(table.ravel(), np.repeat(by_word, 5), none + 1)
        g[none] = 0
        g[none + 1] = by_word.sum()
        into, out, stay = np.exp(p[none + 2 :])
        x = np.exp(np.clip(e[before + 1], -30, 30)) * backward[before + 1]
        f = forward[before]
        total = 1 + into * x + out * f + stay * f * x
        y0, y1 = labels[before], labels[before + 1]
        w = weigh[before]
        starting = marginal[starts[lengths > 0]]
        g[none + 2] = ((~y0 & y1) * w - into * x / total * w).sum() + ((labels[starts[lengths > 0]] - starting) * weigh[0]).sum()
        g[none + 3] = ((y0 & ~y1) * w - out * f / total * w).sum()
        g[none + 4] = ((y0 & y1) * w - stay * f * x / total * w).sum()
        g[:none] -= ridge * p[:none]
        return g

    for again in range(relabel + 1):
        parameters = _ascend(step, parameters, rounds, 0.3 if not again else 0.1)
        if again < relabel:
            _, forward, backward = odds_of(parameters)
            labels = (forward * backward >= 1) & inside
    _, forward, backward = odds_of(parameters)
    top, expected = _evidence(forward * backward, lengths)
    x = np.stack([np.ones(len(top)), top, np.log(np.maximum(expected, NO_WORDS))], 1)

    def document_step(q: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-np.clip(x @ q, -30, 30)))
        return x.T @ (toxic - p) / len(x) - 1e-4 * q

    scale = _ascend(document_step, np.array([0.0, 0.5, 0.5]), 400, 0.05)
    weights = {f: float(parameters[i]) for f, i in names.items() if abs(parameters[i]) > 1e-3}
    return ToxicSpans(weights, float(parameters[none + 1]), np.exp(parameters[none + 2 :]), scale)


def learn_toxicity(docs: DataFrame, labels: DataFrame, train: Column, *, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> ToxicSpans | None:
    """Fit on the labelled documents where ``train`` (a column over the labels) holds."""
    known = labels.where(train & F.col(id_column).isNotNull() & F.col(label_column).isNotNull()).groupBy(F.col(id_column).alias("k")).agg(F.max(F.col(label_column).cast("int")).alias("y"))
    first = lambda y, n: known.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(n)
    sample = common.materialize(first(1, most_toxic).unionByName(first(0, most_clean)), "labels")
    found = docs.select(F.col(id_column).alias("k"), common.text_bytes(text_column).alias("t")).join(F.broadcast(sample), "k")  # the sample's rows, bounded
    texts = found.groupBy("k", "y").agg(F.min("t").alias("t"))
    before = F.sum(F.length("t")).over(Window.orderBy(F.xxhash64("k"), "k"))  # of the sample's rows, bounded
    rows = texts.withColumn("held", before).where(F.col("held") <= MOST_BYTES).orderBy("k").select("t", "y").toArrow()
    model = fit(rows["t"].to_pylist(), rows["y"].to_numpy()) if rows.num_rows else None
    del rows
    common.let_go()  # the driver has other things to hold
    return model


def with_toxicity(docs: DataFrame, model: ToxicSpans | None, *, text_column: str = "text") -> tuple[DataFrame, list[str]]:
    """The documents with two columns more, and the names of these, which no other column has.

    They are the score and the spans (start and end of each, in characters).
    """
    names, at, more = list(docs.columns), docs.columns.index(text_column), common.fresh(docs, "score", "spans")
    held = docs.sparkSession.sparkContext.broadcast(model)  # features of the bounded sample

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, float] = {}
        for batch in common.slices(batches):
            texts = [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]
            scores, spans, lo = [0.0] * len(texts), [[] for _ in texts], 0
            while lo < len(texts) and held.value is not None:
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size < SLICE_BYTES):
                    size += len(texts[hi])
                    hi += 1
                scores[lo:hi], spans[lo:hi] = _tag(held.value, texts[lo:hi], memo)
                lo = hi
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(spans, pa.list_(pa.list_(pa.int32())))], [*names, *more])

    kinds = (T.DoubleType(), T.ArrayType(T.ArrayType(T.IntegerType())))
    return common.map_rows(docs, score, T.StructType([*docs.schema.fields, *map(T.StructField, more, kinds)])), more


def _tag(model: ToxicSpans, texts: list[bytes], memo: dict[bytes, float]) -> tuple[list[float], list[list[list[int]]]]:
    words = [words_of(t) for t in texts]
    new = set().union(*words).difference(memo)
    if len(memo) + len(new) > MEMO_WORDS:
        memo.clear()
        new = set().union(*words)
    memo.update((w, model.emission(w)) for w in new)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    emission = np.concatenate([np.fromiter(map(memo.__getitem__, d), np.float64, len(d)) for d in words])
    forward, backward = chain_odds(emission, lengths, model.transition)
    odds = forward * backward
    scores = model.document_scores(*_evidence(odds, lengths)).tolist()
    spans: list[list[list[int]]] = [[] for _ in texts]
    ends = np.cumsum(lengths)
    hit = np.flatnonzero(odds >= 1)
    for i in np.unique(np.searchsorted(ends, hit, "right")).tolist():
        inside = (odds[ends[i] - lengths[i] : ends[i]] >= 1).astype(np.int8)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], inside, [0])))).reshape(-1, 2).tolist()
        places = [m.span() for m in WORD.finditer(texts[i].translate(WORD_BYTES))]
        char = lambda b, t=texts[i]: len(t[:b].decode("utf-8", "replace"))
        spans[i] = [[char(places[a][0]), char(places[b - 1][1])] for a, b in edges]
    return scores, spans


def toxicity(docs: DataFrame, model: ToxicSpans | None, *, threshold: float = 0.3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: doc_id, score, predicted (1 if score >= threshold) and spans. One narrow pass."""
    kept = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    scored, _ = with_toxicity(kept, model)
    return scored.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")


def without_toxic(docs: DataFrame, model: ToxicSpans | None, *, threshold: float = 0.3, text_column: str = "text") -> DataFrame:
    """The documents that score less than the threshold, all columns kept."""
    scored, (score, _) = with_toxicity(docs, model, text_column=text_column)
    return scored.where(F.col(score) < threshold).select(*common.columns(docs))
