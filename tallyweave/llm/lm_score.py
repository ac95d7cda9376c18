"""Language-model scores from a class-factored log-bilinear model, trained by noise-contrastive estimation on all training text.

Tokens are the words of a text (A-Z lower-cased, cut at ASCII white space) and one end. Each token has a
class: the ``heads`` most frequent tokens are classes of their own, every other token belongs to one of
``buckets`` classes by its last three bytes. The ``ENDINGS`` most frequent endings are clustered by what
stands beside them (eigenvectors of their neighbour counts), so a class keeps to one language or register;
rarer endings share the last class. A bucket's words that are among the ``vocabulary`` most frequent ones are
units of their own, its other words share one unit. A text's probability is the product over its tokens of

- the class given the classes u, v of the two tokens before it (a start class stands before a text), log-bilinear: the
  predicted vector is r = C1 * R[u] + C2 * R[v] (elementwise position weights), the score of class w is r . Q[w] + b[w];
  batched matrix products over all pairs (u, v) give the normalised log-probabilities;
- in a bucket, the unit given the class and the two units before it, log-bilinear in the same way with vectors
  of its own for every unit; batched matrix products over a bucket's units normalise it;
- in a shared unit, the token by counts: c / (C + s) for a token counted c > 0 times, where C is the
  unit's count and s the number of the bucket's tokens counted once (at least 0.1), and s / (C + s) for its one
  unknown token.

So the probabilities of all known tokens and each bucket's unknown token add up to one.

All training documents are counted and trained on: words for the base and the classes, the class triples (u, v, w),
and each token of a bucket in its context. For classes the noise distribution is the unigram distribution and
the expectation over it is taken exactly, on the triples, so that part is full-batch and deterministic; there are at most
(classes + 1)^2 * classes triples. For units every partition of the training text starts from the same vectors (biases
are the counts', so that they begin as the unigram model of each class), draws ``NOISE`` noise units a batch and class from
the counts' distribution and takes one pass of adaptive steps; each unit's vectors are then averaged over the
partitions by how often they saw it, in two rounds, so a pass costs the same a token at every size of the corpus.
The draws are seeded; another division of the same rows into partitions gives slightly other vectors.

Counts of rare words reach the documents by blocks: a block is a hashed share of the documents of about
``BLOCK_BYTES`` (less where there would be fewer blocks than shuffle partitions), asks once for each distinct word, and is joined
with the answers in a task of its own. The heads and the vocabulary, which any block may hold, are broadcast with
the model and answered to no block.

Nulls and other cases: a null or empty text is an end alone; without training documents every token is
unknown (N = V = 0) and the model is uniform over classes; null ids are their own fold (crc32 of the empty text);
repeated rows are all kept and all count; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: The end of a text among words: no word holds a space.
END = b" "
BLOCK_BYTES, LEAST_BLOCK_BYTES = 12 << 20, 1 << 20
ENDINGS = 640
#: Units whose vectors travel as one row.
SLICE_UNITS = 128
#: Of the training of units: noise units a batch and class, tokens a batch, and tokens that wait for being shuffled.
NOISE, BATCH, WAITING = 16, 16_384, 1_000_000
#: Tokens of a bucket that are scored at once: what a processor's cache holds.
CACHED = 2_048
#: What a worker unpacks of a text column at once, and the tokens and words that it looks up or scores at once.
SLICE_BYTES, SLICE_TOKENS = 1 << 20, 1 << 17


def words_of(text: bytes) -> list[bytes]:
    return text.translate(common.LOWER).split()


def cluster(pairs: np.ndarray, buckets: int, dimensions: int = 8) -> np.ndarray:
    """Clusters of endings from their counts side by side (a square matrix): the heaviest is cut in two halves of
    equal mass, along the axis on which its endings differ most, until there are enough. So no class is much larger than another."""
    a = pairs + pairs.T + 1e-3
    degree = a.sum(1)
    root = 1 / np.sqrt(degree)
    values, vectors = np.linalg.eigh(root[:, None] * a * root)
    best = np.argsort(-np.abs(values))[1 : dimensions + 1]
    x = vectors[:, best] * root[:, None] * np.sqrt(degree.sum()) * values[best]
    out, several = np.zeros(len(x), np.int64), [np.arange(len(x))]
    while len(several) < buckets and any(len(at) > 1 for at in several):
        at = several.pop(max(range(len(several)), key=lambda i: (len(several[i]) > 1, degree[several[i]].sum())))
        centred = x[at] - np.average(x[at], 0, degree[at])
        axis = np.linalg.svd(centred * root[at, None] ** -1, full_matrices=False)[2][0]
        at = at[np.argsort(centred @ axis, kind="stable")]
        mass = np.cumsum(degree[at])
        cut = min(max(1, int(np.searchsorted(mass, mass[-1] / 2))), len(at) - 1)
        several += [at[:cut], at[cut:]]
    for i, at in enumerate(several):
        out[at] = i
    return out


class LogBilinear:
    """Class model: ``classes`` classes and, as context only, a start class numbered ``classes``."""

    def __init__(self, heads: list[bytes], buckets: int, endings: dict[bytes, int], size: int = 24):
        self.heads = {w: i for i, w in enumerate(heads)}
        #: Bucket by ending; all others are in the last one.
        self.endings = endings
        self.buckets, self.size = buckets, size
        self.classes = len(heads) + buckets
        self.table = np.full((self.classes + 1, self.classes + 1, self.classes), -np.log(max(1, self.classes)), np.float32)

    def class_of(self, word: bytes) -> int:
        found = self.heads.get(word)
        return len(self.heads) + self.endings.get(word[-3:], self.buckets - 1) if found is None else found

    def train(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, n: np.ndarray, *, noise: float = 25.0, rounds: int = 150, rate: float = 0.05, seed: int = 3) -> LogBilinear:
        """Fit to counts of class triples by noise-contrastive estimation with ``noise`` noise tokens a token."""
        k, d = self.classes, self.size
        if not len(n):
            return self
        total = float(n.sum())
        q = np.bincount(w, n, k) + 0.5
        q /= q.sum()
        pair = u.astype(np.int64) * (k + 1) + v
        pairs, row = np.unique(pair, return_inverse=True)
        seen = np.bincount(row, n) / total
        data = np.zeros((len(pairs), k), np.float32)
        data[row, w] = n / total
        before, last = pairs // (k + 1), pairs % (k + 1)
        rng = np.random.default_rng(seed)
        shapes = ((k + 1, d), (k, d), (k,), (d,), (d,))
        parts = [rng.normal(0, 0.1, s) for s in shapes]
        parts[2], parts[3], parts[4] = np.log(q), np.full(d, 0.5), np.ones(d)
        parts = [p.astype(np.float32) for p in parts]
        m, s = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
        shift = np.log(noise * q).astype(np.float32)
        weight = (seen[:, None] * noise * q).astype(np.float32)
        for t in range(1, rounds + 1):
            R, Q, b, far, near = parts
            r = far * R[before] + near * R[last]
            real = 1 / (1 + np.exp(shift - np.clip(r @ Q.T + b, -30, 30)))  # that the token is no noise
            g = data * (1 - real) - weight * real
            gr = g @ Q
            gR = np.zeros_like(R)
            np.add.at(gR, before, far * gr)
            np.add.at(gR, last, near * gr)
            grads = [gR, g.T @ r, g.sum(0), (gr * R[before]).sum(0), (gr * R[last]).sum(0)]
            for i, x in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * x
                s[i] = 0.99 * s[i] + 0.01 * x * x
                parts[i] = parts[i] + rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.99**t)) + 1e-8)
        R, Q, b, far, near = parts
        for i in range(k + 1):  # by the class two before: one batched product
            scores = (far * R[i] + near * R) @ Q.T + b
            top = scores.max(1, keepdims=True)
            self.table[i] = scores - top - np.log(np.exp(scores - top).sum(1, keepdims=True))
        return self


class Units:
    """Vectors of words: heads, then vocabulary, then one unit for the rest of each bucket; one more, as context only, for the start.

    A bucket's members are its vocabulary and its rest; ``log_q`` is each unit's share of its class by counts, in logarithms.
    """

    def __init__(self, model: LogBilinear, vocabulary: list[bytes], counts: np.ndarray, rest: np.ndarray, once: np.ndarray, size: int = 32, seed: int = 4):
        h, v, b = len(model.heads), len(vocabulary), model.buckets
        self.model, self.words = model, {w: h + i for i, w in enumerate(vocabulary)}
        self.first_rest, self.start = h + v, h + v + b
        #: Counts of heads and vocabulary, known without asking.
        self.counts = counts
        self.bucket_of = np.full(self.start + 1, -1, np.int64)
        self.bucket_of[h : h + v] = [model.class_of(w) - h for w in vocabulary]
        self.bucket_of[h + v : self.start] = np.arange(b)
        self.class_of_unit = np.append(np.where(self.bucket_of[:-1] < 0, np.arange(self.start), self.bucket_of[:-1] + h), model.classes)
        mass = np.zeros(self.start + 1)
        mass[h : h + v], mass[h + v : self.start] = counts[h:], rest + once
        self.members = [np.flatnonzero(self.bucket_of == i) for i in range(b)]
        self.log_q = np.zeros(self.start + 1)
        for m in self.members:
            self.log_q[m] = np.log(np.maximum(mass[m], 1e-9) / np.maximum(mass[m], 1e-9).sum())
        #: Members' own places, and the shares of a rest's known and unknown tokens.
        self.place = np.zeros(self.start + 1, np.int64)
        for m in self.members:
            self.place[m] = np.arange(len(m))
        self.rest, self.once = rest, once
        rng = np.random.default_rng(seed)
        n = self.start + 1
        self.R, self.Q = (rng.normal(0, 0.1, (n, size)).astype(np.float32) for _ in range(2))
        self.Q[:] = 0
        self.b = self.log_q.astype(np.float32)
        self.far, self.near = np.full(size, 0.5, np.float32), np.ones(size, np.float32)

    def unit_of(self, word: bytes) -> int:
        found = self.model.heads.get(word)
        if found is None:
            found = self.words.get(word)
        return self.first_rest + self.model.endings.get(word[-3:], self.model.buckets - 1) if found is None else found

    def trained(self, batches: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], rate: float = 0.15, seed: int = 6) -> tuple[np.ndarray, np.ndarray]:
        """One pass over arrays of units (two before, one before, the unit): for each unit its vectors (R, Q and b, side by
        side) times how often it was seen as a context and as a unit, and these two numbers."""
        rng = np.random.default_rng(seed)
        R, Q, b, far, near = self.R.copy(), self.Q.copy(), self.b.copy(), self.far, self.near
        n, d = R.shape
        seen = np.zeros((2, n))
        sums = [np.full(R.shape, 1e-6, np.float32), np.full(Q.shape, 1e-6, np.float32), np.full(b.shape, 1e-6, np.float32)]
        shares = [np.exp(self.log_q[m]) for m in self.members]
        pull = lambda at, g: np.stack([np.bincount(at, x, n) for x in np.ascontiguousarray(g.T)], 1).astype(np.float32)
        log_noise = (self.log_q + np.log(NOISE)).astype(np.float32)
        for us, vs, ws in batches:
            keep = self.bucket_of[ws] >= 0
            us, vs, ws = us[keep], vs[keep], ws[keep]
            seen[0] += np.bincount(us, minlength=n) + np.bincount(vs, minlength=n)
            seen[1] += np.bincount(ws, minlength=n)
            order = rng.permutation(len(ws))
            step = min(BATCH, max(512, len(order) // 64))  # a short pass takes steps too
            for lo in range(0, len(order), step):
                at = order[lo : lo + step]
                at = at[np.argsort(self.bucket_of[ws[at]], kind="stable")]
                u, v, w = (x[at].astype(np.int64) for x in (us, vs, ws))
                bucket = self.bucket_of[w]
                r = far * R[u] + near * R[v]
                g = 1 - 1 / (1 + np.exp(np.clip(log_noise[w] - b[w] - (r * Q[w]).sum(1), -30, 30)))
                gr, gQ, gb = g[:, None] * Q[w], pull(w, g[:, None] * r), np.bincount(w, g, n).astype(np.float32)
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)])).tolist()
                for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                    if x == y:
                        continue
                    k = int(bucket[x])
                    noise = self.members[k][rng.choice(len(shares[k]), NOISE, p=shares[k])]
                    real = 1 / (1 + np.exp(np.clip(log_noise[noise] - b[noise] - r[x:y] @ Q[noise].T, -30, 30)))
                    gr[x:y] -= real @ Q[noise]
                    np.subtract.at(gQ, noise, real.T @ r[x:y])
                    np.subtract.at(gb, noise, real.sum(0))
                grads = (pull(np.concatenate([u, v]), np.concatenate([gr * far, gr * near])), gQ, gb)
                for x, one, total in zip((R, Q, b), grads, sums, strict=True):
                    one /= len(w)
                    total += one * one
                    x += rate * one / np.sqrt(total)
        return np.concatenate([R * seen[0][:, None], Q * seen[1][:, None], (b * seen[1])[:, None]], 1).astype(np.float64), seen

    def average(self, sums: np.ndarray, seen: np.ndarray) -> None:
        """Take over what partitions have learned; units that none saw stay as they are."""
        d = self.R.shape[1]
        for x, part, n in ((self.R, sums[:, :d], seen[0]), (self.Q, sums[:, d : 2 * d], seen[1]), (self.b, sums[:, 2 * d], seen[1])):
            some = n > 0
            x[some] = part[some] / (n[some][:, None] if x.ndim == 2 else n[some])

    def within_class(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Log-probabilities of units given their classes and the units before them."""
        out = np.zeros(len(w), np.float32)
        bucket = self.bucket_of[w]
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(-1, len(self.members)), "right")
        for k, m in enumerate(self.members):
            Q, b = self.Q[m].T, self.b[m]
            for lo in range(int(ends[k]), int(ends[k + 1]), CACHED) if len(m) > 1 else ():
                at = order[lo : min(lo + CACHED, int(ends[k + 1]))]
                scores = (self.far * self.R[u[at]] + self.near * self.R[v[at]]) @ Q + b
                with np.errstate(over="ignore"):
                    total = np.exp(scores).sum(1)
                if not np.isfinite(total).all():
                    scores -= scores.max(1, keepdims=True)
                    total = np.exp(scores).sum(1)
                out[at] = scores[np.arange(len(at)), self.place[w[at]]] - np.log(total)
        return out


def _blocks(docs: DataFrame, blocks: int, id_column: str, text_column: str, train: Column) -> DataFrame:
    key = F.pmod(F.xxhash64(F.col(id_column), F.col(text_column)), F.lit(blocks)).cast("int")
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), common.text_bytes(text_column).alias("text"), key.alias("block"))


def text_rows(table: pa.Table) -> Iterator[tuple[bool, bytes]]:
    """Whether it is one to learn from, and the text, of every row; unpacked in slices."""
    for batch in common.pieces(table.select(["train", "text"]).to_batches(), SLICE_BYTES):
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def count_block(table: pa.Table) -> pa.Table:
    """(word, block, n) of the documents of one block."""
    trained: Counter = Counter()
    words: set[bytes] = set()
    for train, text in text_rows(table):
        found = words_of(text)
        if train:
            trained.update(found)
            trained[END] += 1
        else:
            words.update(found)
    words.difference_update(trained)
    n = np.zeros(len(trained) + len(words), np.int64)
    n[: len(trained)] = np.fromiter(trained.values(), np.int64, len(trained))
    return pa.table([pa.array(chain(trained, words), pa.binary(), size=len(n)), pa.array(np.full(len(n), table["block"][0].as_py(), np.int32)), pa.array(n)], ["word", "block", "n"])


def block_words(texts: DataFrame) -> DataFrame:
    """(word, block, n): each block's distinct words with their counts in its training documents."""

    def count(table: pa.Table) -> pa.Table:
        found = count_block(table)
        common.let_go()  # the worker has nothing to do in the stages that follow
        return found

    return texts.groupBy("block").applyInArrow(count, "word binary, block int, n long")


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, block, n, c, first): block_words with each word's count c over all training documents.

    One shuffle by word serves the sums and the join with them; first marks one row of each word.
    """
    asked = block_words(texts).repartition(common.shuffle_partitions(texts.sparkSession), "word")
    sums = asked.groupBy("word").agg(F.sum("n").alias("c"), F.min("block").alias("home"))
    return asked.join(sums.hint("merge"), "word").select("word", "block", "n", "c", (F.col("block") == F.col("home")).alias("first"))


def contexts(batches: Iterator[pa.RecordBatch], units: Units, total: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The tokens of batches of texts as arrays of units (two before, one before, the unit) of ``WAITING`` tokens or a little more;
    their class triples are added to ``total``."""
    names, k, start = _Units(units), units.model.classes, units.start
    end = names[END]
    waiting, n = [], 0
    for batch in batches:
        ids = [start, start]
        for text in batch.column(0).to_pylist():
            ids += map(names.__getitem__, words_of(text))
            ids += (end, start, start)
        at = np.array(ids, np.int32)
        del ids
        c = units.class_of_unit[at]
        real = at[2:] != start
        total += np.bincount(((c[:-2] * (k + 1) + c[1:-1]) * k + np.minimum(c[2:], k - 1))[real], minlength=len(total))
        waiting.append((at[:-2][real], at[1:-1][real], at[2:][real]))
        n += len(waiting[-1][0])
        if n >= WAITING:
            waiting, n = [tuple(map(np.concatenate, zip(*waiting, strict=True)))], 0
            yield waiting.pop()  # no longer held here while it is learned from
    if waiting:
        yield tuple(map(np.concatenate, zip(*waiting, strict=True)))


def learn_contexts(texts: DataFrame, units: Units) -> tuple[np.ndarray, np.ndarray]:
    """Class triples of the training texts as (code, n), code = (u * (classes + 1) + v) * classes + w; ``units`` learns from
    the same pass."""
    spark, k = texts.sparkSession, units.model.classes
    held = spark.sparkContext.broadcast(units)  # vectors of heads, vocabulary and rests
    width = 2 * units.R.shape[1] + 3

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        one, total = held.value, np.zeros((k + 1) * (k + 1) * k, np.int64)
        sums, seen = one.trained(contexts(common.slices(batches, SLICE_BYTES), one, total))
        if seen.any():
            where = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int32)), pa.array(total[where]), pa.nulls(len(where), pa.int32()), pa.nulls(len(where), pa.int64()), pa.nulls(len(where), pa.binary())], list(schema))
            table = np.concatenate([sums, seen.T], 1)
            cuts = range(0, len(table), SLICE_UNITS)
            parts = [table[lo : lo + SLICE_UNITS].tobytes() for lo in cuts]
            none = len(parts)
            yield pa.RecordBatch.from_arrays([pa.nulls(none, pa.int32()), pa.nulls(none, pa.int64()), pa.array(range(none), pa.int32()), pa.array([TaskContext.get().partitionId()] * none, pa.int64()), pa.array(parts, pa.binary())], list(schema))

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.float64) for x in table["part"].to_pylist())
        return pa.table([table["slice"][:1].cast(pa.int32()), table["from"][:1].cast(pa.int64()), pa.array([total.tobytes()], pa.binary())], ["slice", "from", "part"])

    schema = {"code": "int", "n": "long", "slice": "int", "from": "long", "part": "binary"}
    found = texts.where("train").select("text").mapInArrow(learn, ", ".join(f"`{c}` {t}" for c, t in schema.items()))
    found = common.materialize(found, "contexts")
    into = max(1, int(texts.rdd.getNumPartitions() ** 0.5))
    parts = found.where(F.col("slice").isNotNull()).select("slice", "from", "part")
    kinds = "slice int, `from` long, part binary"
    some = parts.groupBy("slice", F.pmod("from", F.lit(into))).applyInArrow(add, kinds)
    rows = sorted(some.groupBy("slice").applyInArrow(add, kinds).collect())  # the vectors, once
    if rows:
        table = np.concatenate([np.frombuffer(bytes(r.part), np.float64).reshape(-1, width) for r in rows])
        units.average(table[:, :-2], table[:, -2:].T)
    triples = found.where(F.col("slice").isNull()).groupBy("code").agg(F.sum("n").alias("n")).toArrow()  # (classes + 1)^2 * classes rows at most
    return triples["code"].to_numpy().astype(np.int64), triples["n"].to_numpy()


def ending_pairs(texts: DataFrame, endings: list[bytes]) -> np.ndarray:
    """How often each ending stands before each other one in training texts."""
    n = len(endings)
    held = texts.sparkSession.sparkContext.broadcast({e: i for i, e in enumerate(endings)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, total = held.value.get, np.zeros((n + 1) * (n + 1), np.int64)
        for batch in common.slices(batches, SLICE_BYTES):
            ids = [n]
            for text in batch.column(0).to_pylist():
                ids += [get(w[-3:], n) for w in words_of(text)]
                ids.append(n)
            c = np.array(ids, np.int64)
            total += np.bincount(c[:-1] * (n + 1) + c[1:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["code", "n"])

    found = texts.where("train").select("text").mapInArrow(count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()  # ENDINGS^2 rows at most
    out = np.zeros((n + 1) * (n + 1))
    out[found["code"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(n + 1, n + 1)[:n, :n]


class _Units(dict):
    """Units by word: heads and vocabulary are held, which most tokens are, and a rest's words are looked up by their ending each time."""

    def __init__(self, units: Units):
        super().__init__(units.model.heads | units.words)
        self.first_rest, self.endings, self.last = units.first_rest, units.model.endings, units.model.buckets - 1

    def __missing__(self, word: bytes) -> int:
        return self.first_rest + self.endings.get(word[-3:], self.last)


def fit_units(counted: DataFrame, texts: DataFrame, *, heads: int, buckets: int, vocabulary: int, size: int) -> tuple[Units, int, int]:
    """The trained model, and the numbers of training tokens and of distinct ones."""
    known = counted.where(F.col("first") & (F.col("c") > 0))
    top = known.orderBy(F.desc("c"), "word").limit(heads + vocabulary).select("word", "c").collect()
    listed = [(bytes(r.word), r.c) for r in top]
    own = [END, *(w for w, _ in listed if w != END)]
    heads_first, words = own[:heads], own[heads : heads + vocabulary]
    count = dict(listed)
    other = known.where(~F.col("word").isin([bytearray(w) for w in heads_first]))
    by_ending = other.groupBy(F.substring("word", -3, 3).alias("ending")).agg(F.sum("c").alias("c"), F.count_if(F.col("c") == 1).alias("once"))
    frequent = by_ending.orderBy(F.desc("c"), "ending").limit(ENDINGS).collect()
    names = [bytes(r.ending) for r in frequent]
    where = cluster(ending_pairs(texts, names), buckets - 1).tolist() if names else []
    model = LogBilinear(heads_first, buckets, dict(zip(names, where, strict=True)))
    sizes, once = np.zeros(buckets), np.zeros(buckets)
    for r, b in zip(frequent, where, strict=True):
        sizes[b] += r.c
        once[b] += r.once
    rest = by_ending.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum("once"), F.lit(0))).first()
    sizes[-1], once[-1] = rest[0] - sizes[:-1].sum(), rest[1] - once[:-1].sum()
    for w in words:
        sizes[model.class_of(w) - len(heads_first)] -= count[w]
    units = Units(model, words, np.array([count.get(w, 0) for w in [*heads_first, *words]], np.int64), sizes, np.maximum(once, 0.1), size)
    code, n = learn_contexts(texts, units)
    k = model.classes
    model.train(code // (k * (k + 1)), code // k % (k + 1), code % k, n)
    common.let_go()  # the driver has other things to hold
    all_tokens = known.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    return units, int(all_tokens[0]), int(all_tokens[1])


def score_block(docs: pa.Table, words: pa.Table, units: Units, total: int, distinct: int) -> pa.Table:
    """The result's rows for the documents of one block; ``words`` has counts of words that other blocks hold too."""
    ids: dict[bytes, int] = {END: 0}
    rows, lengths = [np.empty(0, np.int32)], np.zeros(docs.num_rows, np.int64)
    own: list[int] = []
    for i, (_, text) in enumerate(text_rows(docs)):
        found = words_of(text)
        lengths[i] = len(found) + 1
        own += [ids.setdefault(w, len(ids)) for w in found]
        own.append(0)
        if len(own) >= SLICE_TOKENS:
            rows.append(np.array(own, np.int32))
            own.clear()
    tokens = np.concatenate([*rows, np.array(own, np.int32)])
    del rows, own
    train = docs["train"].to_numpy()
    # Counts of words of this block alone are its own; others came with ``words`` or are the model's.
    c = np.bincount(tokens[np.repeat(train, lengths)], minlength=len(ids))
    for batch in words.select(["word", "c"]).to_batches(SLICE_TOKENS):
        at = np.fromiter(map(ids.__getitem__, batch.column(0).to_pylist()), np.int64, batch.num_rows)
        c[at] = batch.column(1).to_numpy()
    unit = np.fromiter(map(_Units(units).__getitem__, ids), np.int32, len(ids))
    del ids
    single = unit < units.first_rest
    c[single] = units.counts[unit[single]]
    share = np.zeros(len(c))
    rest = unit[~single] - units.first_rest
    share[~single] = np.log10(np.where(c[~single] > 0, c[~single], units.once[rest]) / (units.rest + units.once)[rest])
    base = np.log10((c + 0.1) / (total + 0.1 * (distinct + 1)))
    k = units.class_of_unit
    ends = np.cumsum(lengths)
    known, bases, scores = np.zeros(len(lengths), np.int64), np.zeros(len(lengths)), np.zeros(len(lengths))
    lo = 0
    while lo < len(lengths):  # whole documents of about so many tokens
        begin = int(ends[lo] - lengths[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, begin + SLICE_TOKENS, "right")))
        some, starts = tokens[begin : ends[hi - 1]], ends[lo:hi] - lengths[lo:hi] - begin
        w = unit[some]
        v, u = np.roll(w, 1), np.roll(w, 2)
        v[starts], u[starts] = units.start, units.start
        u[starts[lengths[lo:hi] > 1] + 1] = units.start
        logs = (units.model.table[k[u], k[v], k[w]] + units.within_class(u, v, w)) / np.log(10) + share[some]
        known[lo:hi] = np.add.reduceat((c > 0)[some].astype(np.int64), starts)
        bases[lo:hi] = np.add.reduceat(base[some], starts)
        scores[lo:hi] = np.add.reduceat(logs, starts)
        lo = hi
    return pa.table(
        [docs["doc_id"], docs["train"], pa.array(lengths), pa.array(known), pa.array(np.full(len(lengths), total, np.int64)), pa.array(bases), pa.array(scores)],
        ["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    )


def lm_scores(docs: DataFrame, train: Column, *, heads: int = 64, buckets: int = 32, vocabulary: int = 2048, size: int = 16, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, n_known, train_tokens, base_score and score (log10), learning where ``train`` holds."""
    spark = docs.sparkSession
    n_bytes = docs.agg(F.sum(F.octet_length(F.col(text_column).cast("string")))).first()[0] or 0
    blocks = max(1, -(-n_bytes // BLOCK_BYTES), min(common.shuffle_partitions(spark), n_bytes // LEAST_BLOCK_BYTES))
    texts = _blocks(docs, blocks, id_column, text_column, train)
    counted = common.materialize(word_counts(texts), "words")
    units, total, distinct = fit_units(counted, texts, heads=heads, buckets=buckets, vocabulary=vocabulary, size=size)
    held = spark.sparkContext.broadcast((units, total, distinct))  # the class table: (classes + 1)^2 * classes floats; the units' vectors

    def score(docs: pa.Table, words: pa.Table) -> pa.Table:
        found = score_block(docs, words, *held.value)
        common.let_go()
        return found

    single = spark.createDataFrame([(bytearray(w),) for w in [*units.model.heads, *units.words]], "word binary")
    answers = counted.where((F.col("c") > 0) & (F.col("c") != F.col("n"))).select("word", "c", "block").join(F.broadcast(single), "word", "left_anti")  # heads + vocabulary rows
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
