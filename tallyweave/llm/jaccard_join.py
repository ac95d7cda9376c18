"""Exact n-gram Jaccard self-join with skipping by set relations, and its connected components.

A document's set holds the 64-bit hashes of its distinct shingles of ``width`` words (all words as one
shingle if there are fewer). Documents with equal sets are one class and go on as one representative.
Two sets of Jaccard similarity at least t share a token among the first n - ceil(t n) + 1 of either in
any common order of all tokens; the order puts the tokens that occur in many prefixes last.

Index-level skipping: a token's list of prefix entries is kept in blocks of equal set size, each sorted
by position. A probing set skips a whole block where size and its own position can't reach the needed
overlap, and takes only the leading part of a block whose positions can. Entries without a partner are
dropped; the others of a list meet under the list's anchor (its smallest representative). What travels
to a group is the text, which compresses well, and is shingled there; hashes would not compress.

Answer-level skipping: in a group, the overlaps of a set with all others are derived from those of the
most similar set computed before: only the lists of the tokens in which the two differ are read. A group
of more than ``GROUP`` sets or ``GROUP_SHINGLES`` shingles is cut into parts and each pair of parts is joined in a task of its own, so a
task's memory is bounded and no pair is lost. Lists come sorted, one at a time; one of more than
``LONG_LIST`` entries is passed on whole under its first representative, unread. A group gives star edges (a member and its root), never all
pairs; links are counted once, in the smallest common anchor's group. Components come from alternating
large-star and small-star rounds over the edges.

Nulls and other cases: null, empty and wordless texts have an empty set and are linked with nothing;
null ids take part and are ignored when a component's smallest id is taken; repeated rows are all kept
and linked; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Tokens ordered last, at most, and the number of prefixes from which a token is one.
FREQUENT, FREQUENT_FROM = 4_000_000, 16
#: Sets that a task joins with each other, and shingles in them, at most (on average, where parts are dealt by hash).
GROUP, GROUP_SHINGLES = 256, 2_000_000
#: Groups of several parts, and nodes of many edges, that are broadcast.
MOST_BROADCAST = 1_000_000
#: Edges from which a node is one of many.
HUB = 500
#: Entries of a list that a task holds at once.
LONG_LIST = 500_000
#: Sets whose overlaps are kept to derive others from.
PIVOTS = 12
#: Bits of the filter that keeps texts without candidates from being shingled again.
FILTER_BITS = 26


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = text.translate(common.LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), len(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - width + 1
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(32)))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), common.text_bytes(text_column).alias("text"), F.xxhash64(F.col(text_column).cast("string")).alias("text_hash"))


def frequent_tokens(texts: DataFrame, width: int, percent: int) -> np.ndarray:
    """Tokens that are among the smallest of many sets, the most frequent last."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 16 << 20):
            heads = []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, width)
                if len(s):
                    heads.append(s[: prefix_length(len(s), percent)])
            tokens, n = np.unique(np.concatenate(heads) if heads else np.empty(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(n.astype(np.int32))], ["token", "n"])

    counts = texts.mapInArrow(count, "token long, n int").groupBy("token").agg(F.sum("n").alias("n"))
    counts = common.materialize(counts.where(F.col("n") >= FREQUENT_FROM), "frequent")
    # Whole classes of equal counts from the top, as many as FREQUENT leaves room for.
    by_count = counts.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).agg(F.count("*").alias("tokens")).orderBy(F.desc("n")).collect()  # 2**16 rows at most
    least = min((r.n for r, total in zip(by_count, accumulate(r.tokens for r in by_count), strict=True) if total <= FREQUENT), default=1 << 62)
    rows = counts.where(F.col("n") >= least).toArrow()
    tokens = rows["token"].to_numpy().view(np.uint64)
    return tokens[np.lexsort((tokens, rows["n"].to_numpy()))]


def document_sets(texts: DataFrame, frequent: np.ndarray, width: int, percent: int) -> DataFrame:
    """(doc_id, text_hash, n, sign, prefix): size and 128-bit signature of each set and its first tokens in order, packed."""
    spark = texts.sparkSession
    by_token = np.argsort(frequent, kind="stable")
    held = spark.sparkContext.broadcast((frequent[by_token], by_token.astype(np.int32)))  # FREQUENT tokens at most

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, ranks = held.value

        def rank(s: np.ndarray) -> np.ndarray:
            """-1, or the place among the frequent ones."""
            if not len(tokens):
                return np.full(len(s), -1)
            at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
            return np.where(tokens[at] == s, ranks[at], -1)

        for batch in common.slices(batches):
            n, sign, prefix = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, width)
                n.append(len(s))
                if not len(s):
                    sign.append(None)
                    prefix.append(None)
                    continue
                sign.append(xxhash.xxh3_128_digest(s.tobytes()))
                first = s[: (p := prefix_length(len(s), percent))]
                if (rank(first) >= 0).any():
                    first = s[np.lexsort((s, rank(s)))[:p]]
                prefix.append(first.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(sign, pa.binary()), pa.array(prefix, pa.binary())], ["doc_id", "text_hash", "n", "sign", "prefix"])

    return texts.mapInArrow(shingle, "doc_id long, text_hash long, n long, sign binary, prefix binary")


def needed(a, b, percent: int):
    """The smallest overlap of sets of sizes a and b that links them."""
    return -(-percent * (a + b) // (100 + percent))


def partners(n: np.ndarray, at: np.ndarray, percent: int) -> np.ndarray:
    """Which entries of a list, sorted by (size, position), have a partner that can link with them."""
    found = np.zeros(len(n), bool)
    sizes, starts = np.unique(n, return_index=True)
    ends = np.append(starts[1:], len(n))
    for i in range(len(n)):
        size = int(n[i])
        reach = np.searchsorted(sizes, 100 * size // percent, "right")
        for block in range(int(np.searchsorted(sizes, size)), int(reach)):
            m = int(sizes[block])
            need = needed(size, m, percent)
            if size - at[i] < need:
                break  # larger sets need more
            lo, hi = starts[block], ends[block]
            hi = lo + np.searchsorted(at[lo:hi], m - need, "right")
            lo = max(lo, i + 1)
            if hi > lo:
                found[i] = True
                found[lo:hi] = True
    return found


def candidate_groups(reps: DataFrame, percent: int) -> DataFrame:
    """(anchor, rep, n): the entries of each token's list that may link, under the list's smallest representative."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = batch.column(2).to_pylist()
            lengths = np.fromiter((len(p) // 8 for p in packed), np.int64, len(packed))
            rows = np.repeat(np.arange(len(packed)), lengths)
            at = np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(packed), np.int64)), pa.array(batch.column(0).to_numpy()[rows]), pa.array(batch.column(1).to_numpy()[rows].astype(np.int32)), pa.array(at.astype(np.int32))], ["token", "rep", "n", "at"])

    def under_anchors(token: np.ndarray, rep: np.ndarray, n: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        """Whole lists, by token and size."""
        order = np.lexsort((rep, at, n, token))
        token, rep, n, at = token[order], rep[order], n[order], at[order]
        # A list also ends where the next set is too large for any before it.
        new = np.flatnonzero((token[1:] != token[:-1]) | (percent * n[1:].astype(np.int64) > 100 * n[:-1].astype(np.int64))) + 1
        cuts = np.concatenate(([0], new, [len(token)]))
        anchors, members, sizes = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k in np.flatnonzero(np.diff(cuts) > 1).tolist():
            lo, hi = int(cuts[k]), int(cuts[k + 1])
            linked = partners(n[lo:hi], at[lo:hi], percent)
            kept = rep[lo:hi][linked]
            if len(kept) > 1:
                anchors.append(np.full(len(kept), kept.min()))
                members.append(kept)
                sizes.append(n[lo:hi][linked])
        pairs = np.unique(np.stack([np.concatenate(anchors), np.concatenate(members), np.concatenate(sizes)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, i]) for i in range(3)], ["anchor", "rep", "n"])

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by token, size and representative; what is held is the last list, as far as it is known, and a batch."""
        held, long = [np.empty(0, np.int64)] * 4, None  # long: the token of a list that is passed on, and its anchor

        def passed_on(rows: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows[1]), long[1])), pa.array(rows[1]), pa.array(rows[2].astype(np.int64))], ["anchor", "rep", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [np.concatenate([a, batch.column(i).to_numpy()]) for i, a in enumerate(held)]
            if long is not None:
                end = int(np.searchsorted(rows[0], long[0], "right"))
                yield passed_on([x[:end] for x in rows])
                rows = [x[end:] for x in rows]
                long = long if not len(rows[0]) else None
            start = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
            if start:
                yield under_anchors(*(x[:start] for x in rows))
            held = [x[start:] for x in rows]
            if len(held[0]) > LONG_LIST:
                long = (held[0][0], held[1][0])
                yield passed_on(held)
                held = [x[:0] for x in held]
        if len(held[0]):
            yield under_anchors(*held)

    spark = reps.sparkSession
    rows = reps.select("rep", "n", "prefix").mapInArrow(entries, "token long, rep long, n int, at int")
    rows = rows.repartition(common.shuffle_partitions(spark), "token").sortWithinPartitions("token", "n", "rep")
    return rows.mapInArrow(lists, "anchor long, rep long, n long").distinct()


def group_links(sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each set's linked sets (itself not among them), its overlaps derived from a similar set's where that reads less."""
    g = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, g)
    owners = np.repeat(np.arange(g), sizes)
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(flat, kind="stable")
    heads = np.concatenate(([0], np.cumsum(np.bincount(flat))))
    by_token = owners[order]
    rows = np.split(flat, np.cumsum(sizes)[:-1])
    pivots: list[tuple[int, np.ndarray]] = []

    def spread(tokens: np.ndarray) -> np.ndarray:
        """How many of the tokens each set holds."""
        lo, n = heads[tokens], heads[tokens + 1] - heads[tokens]
        places = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
        return np.bincount(by_token[places], minlength=g)

    for i in range(g):
        best = min(pivots, key=lambda p: sizes[i] + sizes[p[0]] - 2 * p[1][i], default=None)
        if best is not None and 2 * (sizes[i] + sizes[best[0]] - 2 * best[1][i]) < sizes[i]:
            j, overlap = best
            overlap = overlap + spread(np.setdiff1d(rows[i], rows[j], assume_unique=True)) - spread(np.setdiff1d(rows[j], rows[i], assume_unique=True))
        else:
            overlap = spread(rows[i])
            pivots = [*pivots[-PIVOTS + 1 :], (i, overlap)]
        linked = (100 + percent) * overlap >= percent * (sizes + sizes[i])
        linked[i] = False
        yield i, np.flatnonzero(linked)


def _join_group(table: pa.Table, width: int, percent: int) -> pa.Table:
    """Star edges and counts of links of one group, or of one pair of its parts."""
    reps = table["rep"].to_numpy()
    part, cross = table["part"].to_numpy(), table["left"][0].as_py() != table["right"][0].as_py()
    anchor, copies = table["anchor"][0].as_py(), table["copies"].to_numpy()
    anchors = table["anchors"].to_pylist()
    sets = [shingle_set(t, width) for t in table["text"].to_pylist()]
    root = np.arange(len(reps))
    links = np.zeros(len(reps), np.int64)
    several = np.fromiter((len(a) > 1 for a in anchors), bool, len(anchors))
    for i, linked in group_links(sets, percent):
        if not len(linked):
            continue
        own = np.unique(root[np.append(linked, i)])
        root[np.isin(root, own)] = own[0]
        counted = linked[part[linked] != part[i]] if cross else linked
        if several[i]:
            mine = set(anchors[i])
            counted = np.array([j for j in counted.tolist() if not several[j] or min(mine.intersection(anchors[j])) == anchor], np.int64)
        links[i] = copies[counted].sum()
    at = np.flatnonzero((root != np.arange(len(reps))) | (links > 0))
    return pa.table([pa.array(reps[at]), pa.array(reps[root[at]]), pa.array(links[at])], ["rep", "root", "links"])


def _beside_low(edges: DataFrame, low: DataFrame) -> DataFrame:
    """Edges (a, b) with m of their a. A node of many edges meets its m where its edges are, not in one task."""
    hubs = low.where(F.col("degree") > HUB)
    if hubs.isEmpty():
        return edges.join(low.select("a", "m"), "a")
    hubs = common.materialize(hubs.orderBy(F.desc("degree"), "a").limit(MOST_BROADCAST).select("a", F.col("m").alias("hub_m")), "hubs")
    met = edges.join(F.broadcast(hubs), "a", "left")
    plain = met.where(F.col("hub_m").isNull()).select("a", "b").join(low.select("a", "m"), "a")
    return met.where(F.col("hub_m").isNotNull()).select("a", "b", F.col("hub_m").alias("m")).unionByName(plain)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node of the edges (a, b), by large-star and small-star rounds."""
    edges = common.materialize(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("degree"))
        large = _beside_low(both, low).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree"))
        small = _beside_low(large, low).select(F.greatest("b", "m").alias("x"), "m", "a")
        small = small.select(F.col("x").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        edges = common.materialize(small, "edges")
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def jaccard_classes(docs: DataFrame, *, width: int = 3, percent: int = 90, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document: doc_id, text_hash, n_shingles, root (null for an empty set), component_id and n_links."""
    spark = docs.sparkSession
    texts = _texts(docs, id_column, text_column)
    frequent = frequent_tokens(texts, width, percent)
    sets = common.materialize(document_sets(texts, frequent, width, percent), "sets")
    classes = sets.where(F.col("sign").isNotNull()).groupBy("sign").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    reps = common.materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")

    pairs = common.materialize(candidate_groups(reps, percent), "groups")
    sizes = pairs.groupBy("anchor").agg(F.greatest(F.ceil(F.count("*") / GROUP), F.ceil(F.sum("n") / GROUP_SHINGLES)).cast("int").alias("parts"))
    large = common.materialize(sizes.where("parts > 1"), "large")
    large = F.broadcast(large) if large.count() <= MOST_BROADCAST else large
    wanted = pairs.groupBy("rep").agg(F.sort_array(F.collect_set("anchor")).alias("anchors"))  # a representative's lists: no more than its prefix
    wanted = common.materialize(wanted.join(reps.select("rep", "sign", "first", "copies"), "rep"), "wanted")
    # A filter of fixed size spares texts that are no candidate's; the join on the signature decides.
    slot = F.pmod(F.xxhash64("first"), F.lit(1 << FILTER_BITS))
    words = wanted.select(slot.alias("slot")).groupBy(F.floor(F.col("slot") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    held = spark.sparkContext.broadcast(bits)  # 2**FILTER_BITS bits

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            at = batch.column(3).to_numpy()
            hit = np.flatnonzero((held.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1))
            texts = batch.column(1).take(pa.array(hit))
            signs = [xxhash.xxh3_128_digest(shingle_set(t, width).tobytes()) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(hit)), pa.array(signs, pa.binary()), texts], ["doc", "sign", "text"])

    slots = texts.withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS)))
    full = slots.mapInArrow(again, "doc long, sign binary, text binary")
    full = full.join(wanted.withColumnRenamed("sign", "s"), (F.col("sign") == F.col("s")) & F.col("doc").eqNullSafe(F.col("first"))).select("rep", "anchors", "copies", "text").dropDuplicates(["rep"])

    dealt = full.withColumn("anchor", F.explode("anchors")).join(large, "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("left", F.least("part", "other")).withColumn("right", F.greatest("part", "other"))
    # Dealt by all three columns: what is dealt by the anchor alone would keep a group's parts in one task.
    dealt = dealt.select("anchor", "left", "right", "part", "rep", "copies", "anchors", "text").repartition("anchor", "left", "right")
    joined = dealt.groupBy("anchor", "left", "right").applyInArrow(lambda t: _join_group(t, width, percent), "rep long, root long, links long")
    links = common.materialize(joined, "links")

    roots = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = reps.select("rep", "sign", "first", "copies").join(roots, F.col("rep") == F.col("node"), "left").withColumn("root", F.coalesce("root", "rep")).drop("node")
    named = named.join(links.groupBy(F.col("rep").alias("l")).agg(F.sum("links").alias("links")), F.col("rep") == F.col("l"), "left")
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    known = named.join(smallest, "root").select(F.col("sign").alias("s"), "root", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = sets.drop("prefix").join(known, F.col("sign") == F.col("s"), "left")
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "root", F.when(F.col("sign").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def jaccard_components(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links) and n_links."""
    return jaccard_classes(docs, **options).select("doc_id", "n_shingles", "component_id", "n_links")


def one_of_each(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The documents, all columns kept, with one document of each component: that of the smallest id.

    Documents without words belong to no group and all stay.
    """
    classes = jaccard_classes(docs, id_column=id_column, text_column=text_column, **options)
    stay = classes.where(F.col("root").isNotNull()).groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("x")).select(F.col("x.doc_id").alias("_id"), F.col("x.text_hash").alias("_hash"))
    own = F.xxhash64(F.col(text_column).cast("string"))
    wordless = F.col(text_column).isNull() | F.col(text_column).cast("string").rlike(r"\A[ \t-\r]*\z")
    row = F.struct(*common.columns(docs))
    rows = docs.where(~wordless).select(row.alias("_row"), F.col(id_column).cast("long").alias("_i"), own.alias("_h"))
    found = rows.join(stay, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hash")))
    once = F.row_number().over(Window.partitionBy("_i", "_h").orderBy(F.xxhash64("_row")))  # rows that repeat one another
    return found.withColumn("_nth", once).where("_nth = 1").select("_row.*").unionByName(docs.where(wordless))
