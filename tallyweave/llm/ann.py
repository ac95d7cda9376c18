"""Approximate nearest neighbours by additive quantisation, with exact reranking.

A vector's direction is the sum of one word from each of ``books`` full-dimensional codebooks, fitted
stage by stage on the residuals of a bounded sample (``SAMPLE`` vectors, the first by a hash of the id).
Every vector is encoded by a beam search over the stages; its codes, the norm that scales the sum back and
the length of what the sum misses are stored. A query's inner products with all codewords make a lookup
table; a stored vector's score is its norm times the sum of one table entry for each of its codes.

Shortlists have no fixed length. What a code misses has length r, so a query of length one misjudges the
vector's direction by r at most, and by about r / sqrt(d) as a rule. ``margin`` times the latter (with
``exact``, r itself, which can't be passed) gives each score a lower and an upper end; the shortlist holds
every vector whose upper end reaches the query's (k + 1)-th best lower end. Groups of nearly equal vectors
therefore come whole. The shortlist is scored exactly on the original vectors in double precision.

The first codeword is a vector's coarse cell. Cells are packed into blocks of about ``BLOCK_VECTORS``
vectors, large cells cut into several. A query first searches the block of its best cell; its (k + 1)-th
best lower end there bounds the final one, and of the other blocks it visits only those that hold a cell
whose best possible score (from the cell's centre, radius and range of norms) reaches it. Every visited pair of
query block and vector block is a task of its own. Vectors without any structure make queries visit all
blocks; that is the price of losing none.

Equal vectors are indexed once, with their smallest k + 1 ids (no result can hold more of them), so a large
group of copies can't fill a shortlist.

Nulls and other cases: vectors that are null, zero, of another length than most of the sample's, or hold
null or non-finite components take no part; null ids take none; rows of one id count once, with the
smallest of their vectors, and ask once if any of them is a query; ties go to the smaller id; fewer candidates than
``k`` give as many as there are; an empty table gives an empty result; other columns are never read.
Vectors of doubles are scored as doubles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Vectors that codebooks are fitted on, at most.
SAMPLE = 20_000
BLOCK_QUERIES, BLOCK_VECTORS = 1024, 1 << 16
#: What single precision may add to a cosine.
SLACK = 1e-5


def _usable(column: Column) -> Column:
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return column.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(column, lambda x: x != 0)


class AdditiveQuantiser:
    """``books`` codebooks of ``words`` codewords each, of shape (books, words, dimensions)."""

    def __init__(self, codebooks: np.ndarray, beam: int):
        self.codebooks, self.beam = codebooks.astype(np.float32), beam

    @classmethod
    def fit(cls, sample: np.ndarray, books: int = 32, words: int = 256, beam: int = 4, rounds: int = 6, seed: int = 5) -> AdditiveQuantiser:
        rng = np.random.default_rng(seed)
        rest = _directions(sample)
        words = max(1, min(words, len(rest)))
        found = []
        for _ in range(books):
            centres = rest[rng.choice(len(rest), words, replace=False)].copy()
            for _ in range(rounds):
                near = (rest @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)
                n = np.bincount(near, minlength=words)
                sums = np.zeros_like(centres)
                np.add.at(sums, near, rest)
                centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
            near = (rest @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)
            rest = rest - centres[near]
            found.append(centres)
        return cls(np.stack(found), beam)

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Codes (n, books), what scales a decoded sum to the vector's length, that length, the length of what the
        scaled sum misses of the direction, and the direction's distance from its cell's centre."""
        unit = _directions(vectors)
        n, d = unit.shape
        words = self.codebooks.shape[1]
        rests = unit[:, None, :]
        codes = np.zeros((n, 1, 0), np.uint8)
        for book in self.codebooks:
            beams = rests.shape[1]
            # Squared length of each beam's residual after each word, up to what is the same for all words of a beam.
            cost = (rests**2).sum(2)[:, :, None] - 2 * (rests.reshape(-1, d) @ book.T).reshape(n, beams, words) + (book**2).sum(1)
            flat = cost.reshape(n, -1)
            keep = min(self.beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            from_beam, word = best // words, best % words
            rows = np.arange(n)[:, None]
            rests = rests[rows, from_beam] - book[word]
            codes = np.concatenate([codes[rows, from_beam], word[:, :, None].astype(np.uint8)], 2)
        best = (rests**2).sum(2).argmin(1)
        codes = codes[np.arange(n), best]
        decoded = self.codebooks[np.arange(len(self.codebooks)), codes].sum(1)
        length, norms = np.maximum(_norms(decoded), 1e-12), _norms(vectors)
        missed = _norms(unit - decoded / length[:, None])
        return codes, norms / length, norms, missed, _norms(unit - self.codebooks[0][codes[:, 0]])

    def scores(self, queries: np.ndarray, codes: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """Approximate inner products, by lookup tables."""
        return self.looked_up(self.tables(queries), codes) * scale

    def tables(self, queries: np.ndarray) -> np.ndarray:
        return np.einsum("qd,bwd->bqw", queries, self.codebooks, optimize=True)

    @staticmethod
    def looked_up(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
        out = tables[0][:, codes[:, 0]]
        for b in range(1, len(tables)):
            out += tables[b][:, codes[:, b]]
        return out


def _norms(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    top = np.maximum(np.abs(x).max(1, initial=0), 1e-300)
    return top * np.sqrt(((x / top[:, None]) ** 2).sum(1))


def _directions(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.maximum(np.abs(x).max(1, initial=0), 1e-300)[:, None]
    return (x / np.maximum(np.sqrt((x**2).sum(1)), 1e-300)[:, None]).astype(np.float32)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _reaching(model: AdditiveQuantiser, queries: np.ndarray, floor: np.ndarray, codes: np.ndarray, scale: np.ndarray, norms: np.ndarray, missed: np.ndarray, k: int, margin: float | None) -> tuple[np.ndarray, ...]:
    """Rows (query, vector, low, high) of the vectors whose upper end reaches ``floor`` and the k-th best lower end here."""
    d = queries.shape[1]
    width = (missed if margin is None else np.minimum(missed, margin * missed / np.sqrt(d) + missed**2 / 2)) + SLACK
    tables, best = model.tables(queries), np.repeat(floor[:, None], k, 1)
    parts = []
    for lo in range(0, len(codes), 8192):
        hi = min(lo + 8192, len(codes))
        near, spread = model.looked_up(tables, codes[lo:hi]) * scale[lo:hi], norms[lo:hi] * width[lo:hi]
        low = near - spread
        best = np.partition(np.concatenate([best, low], 1), -k, axis=1)[:, -k:]
        at = np.nonzero(near + spread >= np.maximum(best.min(1), floor)[:, None])
        parts.append((at[0], at[1] + lo, low[at], (near + spread)[at]))
    row, col, low, high = (np.concatenate(x) for x in zip(*parts, strict=True))
    kept = high >= np.maximum(best.min(1), floor)[row]
    return row[kept], col[kept], low[kept], high[kept]


def _packed_cells(sizes: dict[int, int], book: np.ndarray) -> dict[int, tuple[int, int]]:
    """By cell, its first block and number of blocks: small cells share one with near ones, large ones have several."""
    left, chain = sorted(sizes), []
    while left:  # from each cell to the nearest that is left
        distance = ((book[left] - book[chain[-1]]) ** 2).sum(1) if chain else np.zeros(1)
        chain.append(left.pop(int(distance.argmin())))
    out, block, held = {}, -1, BLOCK_VECTORS
    for cell in chain:
        n = sizes[cell]
        if n > BLOCK_VECTORS:
            parts = -(-n // BLOCK_VECTORS)
            out[cell] = (block + 1, parts)
            block, held = block + parts, BLOCK_VECTORS
            continue
        if held + n > BLOCK_VECTORS:
            block, held = block + 1, 0
        out[cell] = (block, 1)
        held += n
    return out


def nearest(vectors: DataFrame, is_query: Column, *, k: int = 20, margin: float = 2.0, exact: bool = False, books: int = 32, beam: int = 4, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's ``k`` vectors of largest inner product found."""
    spark = vectors.sparkSession
    kind = "array<float>" if dict(vectors.dtypes)[vector_column] == "array<float>" else "array<double>"
    usable = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast(kind).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where(_usable(F.col("v")) & F.col("id").isNotNull())
    sample = usable.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not len(sample):
        return empty
    lengths = np.diff(sample.offsets.to_numpy())
    dimension = int(np.bincount(lengths).argmax())
    model = AdditiveQuantiser.fit(_matrix(sample.filter(pa.array(lengths == dimension))), books, beam=beam)
    held = spark.sparkContext.broadcast(model)  # books x 256 vectors

    rows = usable.where(F.size("v") == dimension).groupBy("id").agg(F.min("v").alias("v"), F.max("q").alias("q"))
    rows = common.materialize(rows, "rows")
    copies = Window.partitionBy("v").orderBy("id")
    distinct = rows.drop("q").withColumn("nth", F.row_number().over(copies)).where(F.col("nth") <= k + 1).withColumn("first", F.min("id").over(Window.partitionBy("v")))
    members = common.materialize(distinct.select("first", "id", "nth", "v"), "vectors")

    def encode(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                codes, *rest = held.value.encode(_matrix(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(codes[:, 0].astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), *map(pa.array, rest)], ["first", "cell", "codes", "scale", "norm", "missed", "apart"])

    index = members.where(F.col("nth") == 1).select("first", "v").mapInArrow(encode, "first long, cell int, codes binary, scale double, norm double, missed double, apart double")
    index = common.materialize(index, "index")
    cells = index.groupBy("cell").agg(F.count("*").alias("n"), F.max("apart").alias("radius"), F.min("norm").alias("least"), F.max("norm").alias("most")).orderBy("cell").collect()  # 256 rows at most
    places = _packed_cells({c.cell: c.n for c in cells}, model.codebooks[0])
    table = spark.createDataFrame([(c, *p) for c, p in places.items()], "cell int, block int, parts int")
    index = index.join(F.broadcast(table), "cell").select((F.col("block") + F.pmod(F.xxhash64("first"), F.col("parts")).cast("int")).alias("ib"), "first", "codes", "scale", "norm", "missed")

    centres = model.codebooks[0][[c.cell for c in cells]]
    radius, least, most = (np.array([c[x] for c in cells]) for x in ("radius", "least", "most"))
    first_block, parts = (np.array([places[c.cell][i] for c in cells], np.int64) for i in (0, 1))

    def highest(unit: np.ndarray) -> np.ndarray:
        """Per query and cell, a score that no member can pass."""
        cosine = np.minimum(unit @ centres.T + radius + SLACK, 1 + SLACK)
        return np.where(cosine > 0, cosine * most, cosine * least)

    def home(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                cell = highest(_directions(_matrix(part.column(1)))).argmax(1)
                ib = first_block[cell] + part.column(0).to_numpy() % parts[cell]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ib.astype(np.int32))], ["query_id", "qv", "ib"])

    queries = rows.where("q").select(F.col("id").alias("query_id"), F.col("v").alias("qv"))
    asked = common.materialize(queries.mapInArrow(home, f"query_id long, qv {kind}, ib int"), "queries")
    # Queries of one home block make query blocks of their own, so that they visit the same blocks.
    by_home = asked.groupBy("ib").agg(F.count("*").alias("n"))
    asked = asked.join(by_home, "ib").select("query_id", "qv", "ib", F.col("ib").alias("home"), F.pmod(F.xxhash64("query_id"), F.ceil(F.col("n") / BLOCK_QUERIES)).cast("int").alias("part"))
    m = None if exact else margin

    def search(asked: pa.Table, stored: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        if asked.num_rows and stored.num_rows:
            ids, (scale, norms, missed) = stored["first"].to_numpy(), (stored[c].to_numpy() for c in ("scale", "norm", "missed"))
            codes = np.frombuffer(b"".join(stored["codes"].to_pylist()), np.uint8).reshape(len(ids), -1)
            wanted, unit, floor = asked["query_id"].to_numpy(), _directions(_matrix(asked["qv"].combine_chunks())), asked["floor"].to_numpy()
            for lo in range(0, len(wanted), 128):
                row, col, low, high = _reaching(held.value, unit[lo : lo + 128], floor[lo : lo + 128], codes, scale, norms, missed, k + 1, m)
                for x, y in zip(out, (wanted[lo : lo + 128][row], ids[col], low, high), strict=True):
                    x.append(y)
        kinds = (np.int64, np.int64, np.float64, np.float64)
        return pa.table([pa.array(np.concatenate([*x, np.empty(0, t)]).astype(t)) for x, t in zip(out, kinds, strict=True)], ["query_id", "first", "low", "high"])

    def searched(visits: DataFrame, label: str) -> DataFrame:
        visits = common.materialize(visits, "visits")
        needed = visits.select(F.col("home").alias("h"), F.col("part").alias("p"), F.col("ib").alias("b")).distinct()
        left, right = visits.groupBy("home", "part", "ib"), index.join(needed, F.col("ib") == F.col("b")).drop("ib").groupBy("h", "p", "b")
        return common.materialize(left.cogroup(right).applyInArrow(search, "query_id long, first long, low double, high double"), label)

    def ends(found: DataFrame) -> DataFrame:
        """(query_id, floor): the (k + 1)-th best lower end of each query that has as many."""
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("low"), "first"))
        return found.withColumn("n", nth).where(F.col("n") <= k + 1).groupBy("query_id").agg(F.when(F.count("*") == k + 1, F.min("low")).otherwise(F.lit(float("-inf"))).alias("floor"))

    found = searched(asked.withColumn("floor", F.lit(float("-inf"))), "found")
    n_blocks = int((first_block + parts).max())
    if n_blocks > 1:

        def others(batches):
            for batch in batches:
                for lo in range(0, batch.num_rows, 1024):
                    part = batch.slice(lo, 1024)
                    floor = part.column(4).to_numpy()
                    row, cell = np.nonzero(highest(_directions(_matrix(part.column(1)))) >= floor[:, None])
                    # Each cell's blocks, without the home block and without those met twice.
                    n = parts[cell]
                    row, block = np.repeat(row, n), np.repeat(first_block[cell], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    pairs = np.unique(np.stack([row, block], 1)[block != part.column(2).to_numpy()[row]], axis=0)
                    for a in range(0, len(pairs), 8192):
                        some = part.take(pa.array(pairs[a : a + 8192, 0]))
                        yield pa.RecordBatch.from_arrays([*some.columns, pa.array(pairs[a : a + 8192, 1].astype(np.int32))], ["query_id", "qv", "home", "part", "floor", "ib"])

        more = asked.join(ends(found), "query_id", "left").select("query_id", "qv", "home", "part", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
        found = found.unionByName(searched(more.mapInArrow(others, f"query_id long, qv {kind}, home int, part int, floor double, ib int"), "found"))
    short = found.join(ends(found), "query_id").where("high >= floor").select("query_id", "first")
    pairs = short.join(members, "first").where(F.col("id") != F.col("query_id")).join(queries, "query_id")

    def rescore(batches):
        for batch in batches:
            a, b = _matrix(batch.column(2)), _matrix(batch.column(3))
            score = np.zeros(len(a))
            for i in range(a.shape[1]):  # component by component, as a plain loop adds them
                score += a[:, i] * b[:, i]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(score)], ["query_id", "vec_id", "score"])

    scored = pairs.select("query_id", "id", "v", "qv").mapInArrow(rescore, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
