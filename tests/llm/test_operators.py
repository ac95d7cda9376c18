"""Each operator against brute force on a small fixture of odd rows, an exact round trip or held-out accuracy."""

import hashlib
import json
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyweave.llm import ann, chat, chunks, common, decontaminate, jaccard_join, language_id, lm_score, mixing, token_counts, token_store, toxicity

BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, score string, spans string, `a.b` string, _row string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def rows():
    rng = np.random.default_rng(4)
    vocabulary = ["".join(rng.choice(list("abcdeghiklmnorstuéñß"), rng.integers(2, 8))) for _ in range(300)]
    made = [(i, " ".join(rng.choice(vocabulary, rng.integers(1, 60))) + ".", "en", f"s{i % 4}") for i in range(60)]
    long = " ".join(rng.choice(vocabulary, 5_000))
    near = made[3][1].split()
    odd = [
        None, "", " ", "\n\t ", "  a  b   c", "a \n b\n\n  c ", "x", "It's WE'LL 'd <|endoftext|> end", "one two", "　wide　 space  here", "a\u0085 b", long, long, made[3][1], made[3][1],
        " ".join([*near, "tail"]), "### | 12 34 %%", "日本語 text 5", "no-space-" * 300,
    ]
    made += [(100 + i, t, None if i % 5 == 0 else "fr", None if i % 3 == 0 else "s1") for i, t in enumerate(odd)]
    made += [made[5], made[5], (None, "null id", "en", "s0"), (None, None, None, None), (7, "same id, other text", "en", "s2")]
    return [(*r, "x", "y", "z", "w") for r in made]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shape(made):
    return Counter((r[0], r[1]) for r in made)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(docs, name):
    path = public_tokenizers.path(name)
    found = Counter(map(tuple, token_counts.token_counts(docs, path, limit=20).collect()))
    if name.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    else:
        tokenizer = Tokenizer.from_file(path)
        count = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    assert found == Counter((r[0], len((r[1] or "").encode()), (n := count(r[1] or "")), n > 20) for r in rows())


def test_chunks_join_to_whole_texts_around_any_code_point():
    """All white space and every 53rd code point, beside spaces on either side."""
    tokenizer = Tokenizer.from_file(BPE)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c % 53 == 0 or chr(c).isspace())]
    texts = [form.format(c) for c in points for form in ("a{0} b", "a {0}b", "{0} b", " {0} {0} c")]
    found = chunks.id_memo(chunks.tokenizer_of(open(BPE, "rb").read()), "H").totals([t.encode() for t in texts])
    whole = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    assert all(np.frombuffer(a, "<u2").tolist() == b.ids for a, b in zip(found, whole, strict=True))


def test_whole_tokens_are_single_pre_tokens():
    tokenizer = Tokenizer.from_file(BPE)
    whole = token_counts.whole_tokens(tokenizer)
    assert len(whole) > 40_000
    for s in sorted(whole)[::500]:
        assert len(tokenizer.encode(s, add_special_tokens=False).ids) == 1


def test_token_store_round_trip(spark, docs):
    store = token_store.write_token_store(docs, BPE, common.new_dir(spark, "t"), end_id=0, shards=3)
    found = token_store.TokenStore.open(store.uri).documents(spark).collect()
    tokenizer = Tokenizer.from_file(BPE)
    encoded = {r[1]: [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in rows()}
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == Counter((r[0], len(encoded[r[1]]), crc(encoded[r[1]])) for r in rows())
    by_start = sorted(found, key=lambda r: r.start)
    assert [r.start for r in by_start] == np.cumsum([0, *(r.n_tokens for r in by_start)])[:-1].tolist()
    keys = [-1 if r.doc_id is None else r.doc_id for r in by_start]
    assert keys == sorted(keys)


def test_token_store_empty(spark, empty):
    assert token_store.token_output(empty, BPE).collect() == []


def test_contamination_against_brute_force(spark, docs, empty):
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    texts = [r[1] for r in rows()]
    long = texts[60 + 11].split()
    items = [(1, " ".join(long[100:130])), (2, "ONE, two!"), (2, texts[9]), (3, None), (4, "..."), (None, " ".join(long[200:215])), (5, "x"), (6, " ".join(long[105:117])), (1, "never seen words here at all in any of them")]
    windows = defaultdict(set)
    for item, text in items:
        w = words.findall(low(text))
        m = min(10, len(w))
        for k in range(len(w) - m + 1 if w else 0):
            windows[tuple(w[k : k + m])].add(item)
    expected = Counter()
    for r in rows():
        w = words.findall(low(r[1]))
        hit, named = set(), set()
        for m in {len(k) for k in windows}:
            for k in range(len(w) - m + 1):
                if (x := windows.get(tuple(w[k : k + m]))) is not None:
                    hit.update(range(k, k + m))
                    named |= x - {None}
        ids = ",".join(sorted(map(str, named)))
        expected[(r[0], len(w), len(hit), len(named), hashlib.sha256(ids.encode()).hexdigest(), bool(hit))] += 1
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for chunk in (200_000, 12, 25):  # one automaton, and one for each few words of items, some of which are longer
        assert Counter(map(tuple, decontaminate.contamination(docs, benchmark, chunk_words=chunk).collect())) == expected
    assert not any(r.contaminated for r in decontaminate.contamination(docs, benchmark.limit(0)).collect())
    assert decontaminate.contamination(empty, benchmark).collect() == []


def test_remove_passages(spark, docs):
    long = rows()[60 + 11][1].split()
    benchmark = spark.createDataFrame([(1, " ".join(long[100:130])), (2, rows()[9][1])], "item_id long, text string")
    out = decontaminate.remove_passages(docs, benchmark, max_coverage=0.5)
    assert out.columns == docs.columns
    kept = Counter((r.doc_id, r.text) for r in out.collect())
    clean = decontaminate.contamination(out, benchmark).where("contaminated").count()
    assert clean == 0
    hit = {r.doc_id for r in decontaminate.contamination(docs, benchmark).where("contaminated").collect()}
    assert {9, 111, 112} <= hit
    assert 9 not in {k[0] for k in kept} and 111 in {k[0] for k in kept}
    untouched = Counter({k: n for k, n in shape(rows()).items() if k[0] not in hit})
    assert Counter({k: n for k, n in kept.items() if k[0] not in hit}) == untouched


def brute_links(texts):
    sets = []
    for t in texts:
        w = WORD.findall(low(t))
        sets.append(frozenset(tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))) if w else frozenset())
    linked = [[j for j in range(len(sets)) if j != i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])] for i in range(len(sets))]
    root = list(range(len(sets)))
    for _ in sets:
        root = [min([root[i], *(root[j] for j in linked[i])]) for i in range(len(sets))]
    return sets, linked, root


def near_copies():
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(400)]
    out, base = [], list(rng.choice(words, 120))
    for i in range(70):
        text = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 6)):
            text[at] = f"e{i}x{at}"
        out.append((500 + i, " ".join(text)))
    return out


@pytest.mark.parametrize("group", [2048, 16, 3])
def test_jaccard_components(spark, docs, empty, monkeypatch, group):
    monkeypatch.setattr(jaccard_join, "GROUP", group)
    monkeypatch.setattr(jaccard_join, "GROUP_SHINGLES", 2_000 if group == 3 else jaccard_join.GROUP_SHINGLES)
    monkeypatch.setattr(jaccard_join, "LONG_LIST", 8 if group == 3 else jaccard_join.LONG_LIST)
    monkeypatch.setattr(jaccard_join, "FREQUENT", 20 if group == 16 else jaccard_join.FREQUENT)
    monkeypatch.setattr(jaccard_join, "HUB", 4 if group == 16 else jaccard_join.HUB)
    monkeypatch.setattr(jaccard_join, "FREQUENT_FROM", 3)
    made = [(r[0], r[1]) for r in rows()] + near_copies()
    sets, linked, root = brute_links([t for _, t in made])
    ids = defaultdict(list)
    for (i, _), r, s in zip(made, root, sets, strict=True):
        if s and i is not None:
            ids[r].append(i)
    expected = Counter((i, len(s), min(ids[r], default=None) if s else i, len(links)) for (i, _), s, r, links in zip(made, sets, root, linked, strict=True))
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    assert Counter(map(tuple, jaccard_join.jaccard_components(df).collect())) == expected
    if group == 16:
        assert jaccard_join.jaccard_components(empty).collect() == []
        kept = jaccard_join.one_of_each(docs)
        assert kept.columns == docs.columns
        mine = [(r[0], r[1]) for r in rows()]
        sets, _, root = brute_links([t for _, t in mine])
        assert kept.count() == len({r for r, s in zip(root, sets, strict=True) if s}) + sum(not s for s in sets)


def test_partners_skip_nothing_that_can_link():
    rng = np.random.default_rng(1)
    n = np.sort(rng.integers(5, 40, 60))
    at = np.array([rng.integers(0, jaccard_join.prefix_length(int(x), 90)) for x in n])
    order = np.lexsort((at, n))
    n, at = n[order], at[order]
    can = lambda i, j: 1 + min(n[i] - at[i] - 1, n[j] - at[j] - 1) >= jaccard_join.needed(n[i], n[j], 90) and 100 * min(n[i], n[j]) >= 90 * max(n[i], n[j])
    assert jaccard_join.partners(n, at, 90).tolist() == [any(can(i, j) for j in range(60) if j != i) for i in range(60)]


def plain_targets(sizes, weights, cap=3.0):
    """Shares of all sizes by weight; a target stops at ``cap`` times its source's size, the excess shared anew."""
    out, left, free = [0.0] * len(sizes), float(sum(sizes)), list(range(len(sizes)))
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > cap * sizes[i]]
        for i in over or free:
            out[i] = cap * sizes[i] if over else left * weights[i] / total
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in set(over)] if over else []
    return out


def check_draws(mix):
    """Each block draw of a source is one shard's, as the tree's leaves say, and shards have equal numbers of them."""
    plans = {p.source: p for p in mix.plans.collect()}
    drawn = mix.rows().select("_row.source", "shard", "draw").distinct().collect()
    owner = {(r.source, r.draw): r.shard for r in drawn}
    assert len(owner) == len(drawn)  # no draw is two shards'
    by_shard = Counter()
    for p in plans.values():
        ends = [0, *(c.end for c in p.cuts)]
        assert ends[-1] == p.quota == p.passes * len(p.order) + p.n_full + bool(p.picks or p.extra)
        for c, lo, hi in zip(p.cuts, ends, ends[1:], strict=False):
            by_shard[c.shard] += hi - lo
            assert {owner.get((p.source, d), c.shard) for d in range(lo, hi)} == {c.shard}
    numbers = [by_shard[s] for s in range(mix.shards)]
    assert max(numbers) - min(numbers) <= 1
    return plans


@pytest.mark.parametrize("broadcast", [True, False])
def test_mix(docs, empty, monkeypatch, broadcast):
    monkeypatch.setattr(mixing, "PLAN_BYTES", mixing.PLAN_BYTES if broadcast else -1)
    weights = (5, 2, 1)
    made = rows()
    sizes = Counter()
    for r in made:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    order = sorted(sizes, key=lambda x: (x is None, x or ""))
    goals = dict(zip(order, plain_targets([sizes[s] for s in order], [weights[i % 3] for i in range(len(order))]), strict=True))
    mix = mixing.Mix(docs, weights=weights, shards=5)
    found = mix.counts().collect()
    source = {r[0]: r[3] for r in made if r[0] is not None}
    assert Counter((r.doc_id, r.size) for r in found) == Counter((r[0], len(WORD.findall(r[1] or ""))) for r in made)
    taken = Counter()
    for r in found:
        assert 0 <= r.taken <= 3 * r.size
        if r.doc_id is not None and r.doc_id != 7:
            assert (r.source_size, r.target) == (sizes[source[r.doc_id]], pytest.approx(goals[source[r.doc_id]]))
    plans = check_draws(mix)
    for s in order:
        largest = max(len(WORD.findall(r[1] or "")) for r in made if r[3] == s)
        assert abs(plans[s].gap) <= max(3, 0.02 * sizes[s], largest / 2)
    drawn = mix.rows().collect()
    assert {r.shard for r in drawn} <= set(range(5))
    for r in drawn:
        taken[r._row.source] += len(WORD.findall(r._row.text or ""))
    assert {s: taken[s] for s in order} == {s: round(goals[s] - plans[s].gap) for s in order}
    assert sum(r.taken for r in found) == sum(taken.values())
    assert Counter(map(tuple, mixing.Mix(docs, shards=5).counts().collect())) == Counter(map(tuple, found))
    shuffled = mix.shuffled()
    assert shuffled.columns == docs.columns and Counter(map(str, shuffled.collect())) == Counter(str(r._row) for r in drawn)
    if broadcast:
        assert mixing.Mix(empty).counts().collect() == [] and mixing.Mix(empty).shuffled().collect() == []


@pytest.mark.parametrize("share", [0.17, 0.5])
def test_mix_skips_a_document_larger_than_what_is_missing(spark, share):
    """A source of small documents and a long one meets its target within a small document, wherever the long one stands."""
    rng = np.random.default_rng(3)
    sizes = rng.integers(20, 120, 3_000)
    sizes[0] = int(sizes[1:].sum() * share / (1 - share))
    made = [(i, " ".join(["w"] * int(n)), f"s{k}") for k in range(6) for i, n in enumerate(sizes, 10_000 * k)]
    df = spark.createDataFrame(made, "doc_id long, text string, source string").repartition(4)
    # Six sources, so six places of the long document, each to take 0.4 x size: the seventh takes the rest.
    other = spark.createDataFrame([(-1, " ".join(["v"] * int(sizes.sum() * 3.6)), "z")], df.schema)
    mix = mixing.Mix(df.unionByName(other), weights=(0.4, 0.4, 0.4, 0.4, 0.4, 0.4, 7.2), cap=3.0, blocks=256, shards=5)
    taken = Counter()
    for r in mix.counts().collect():
        taken["z" if r.doc_id < 0 else f"s{r.doc_id // 10_000}"] += r.taken
    plans = check_draws(mix)
    for k in range(6):
        p = plans[f"s{k}"]
        assert p.target == pytest.approx(0.4 * sizes.sum(), rel=0.01)
        assert taken[p.source] == round(p.target - p.gap) and abs(p.gap) <= 20


def test_mix_of_many_sources(spark):
    """12,000 sources, one of them with a third of the rows."""
    rng = np.random.default_rng(4)
    made = [(i, " ".join(["w"] * int(n)), f"host{i % 12_000}" if i % 3 else "hot") for i, n in enumerate(rng.integers(0, 30, 30_000))]
    sizes = Counter()
    for _, t, s in made:
        sizes[s] += len(t.split())
    order = sorted(sizes)
    goals = dict(zip(order, plain_targets([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))]), strict=True))
    mix = mixing.Mix(spark.createDataFrame(made, "doc_id long, text string, source string").repartition(4), shards=7)
    taken = Counter()
    for r in mix.counts().collect():
        s = made[r.doc_id][2]
        assert r.target == pytest.approx(goals[s]) and r.source_size == sizes[s] and r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - goals[s]) <= 15 for s in order)
    assert len(order) > 8_000 and sum(taken.values()) == pytest.approx(sum(goals.values()), rel=0.05)
    # Past a part a shard: parts are ranges of the shard's local order.
    mix.parts = 3
    assert mix.shuffled().count() == mix.rows().count()


def test_tree():
    assert plain_targets([100, 10, 1000], [5, 2, 1]) == pytest.approx([300, 30, 780])
    leaves = mixing.split_quotas([100, 7, 0, 33], 8, seed=1)
    assert leaves.sum(0).tolist() == [100, 7, 0, 33] and leaves.sum(1).max() - leaves.sum(1).min() <= 1
    lower = np.array(list(mixing.split_draws(leaves[:, 0], [40, 0, 35, 25], np.random.default_rng(1))))
    assert lower.sum(1).tolist() == [40, 0, 35, 25] and lower.sum(0).tolist() == leaves[:, 0].tolist() and (lower >= 0).all()
    have = np.array([3_000_000_000, 5, 2_000_000_001])
    some = mixing.hypergeometric(have, 1_000_000_007, np.random.default_rng(2))
    assert some.sum() == 1_000_000_007 and (some >= 0).all() and (some <= have).all()


def exact_neighbours(made, k):
    """By query id, the true neighbours as (id, score), of rows (id, vector) that are all usable; rows of one id count once."""
    by_id = {}
    for i, v in made:
        by_id[i] = min(by_id.get(i, v), v)
    ids = np.array(sorted(by_id))
    d = np.array([by_id[i] for i in ids.tolist()], np.float64)
    out = {}
    for q in ids[ids % 20 == 0].tolist():
        scores = d @ np.array(by_id[q], np.float64)
        best = [j for j in np.lexsort((ids, -scores)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), scores[j]) for j in best]
    return out


def compare_neighbours(found, truth, least):
    by_query = defaultdict(list)
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        by_query[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(by_query) == set(truth)
    hit = 0
    for q, got in by_query.items():
        assert [n for n, _, _ in got] == list(range(1, len(truth[q]) + 1))
        assert [v for _, v, _ in got] == [v for _, v, _ in sorted(got, key=lambda x: (-x[2], x[1]))]
        assert len({v for _, v, _ in got}) == len(got)
        hit += len({v for _, v, _ in got} & {v for v, _ in truth[q]})
        known = dict(truth[q])
        assert all(s == pytest.approx(known[v], rel=1e-12, abs=1e-12) for _, v, s in got if v in known)
    assert hit >= least * sum(map(len, truth.values()))


@pytest.mark.parametrize("blocks", [1, 20])
def test_nearest_neighbours(spark, monkeypatch, blocks):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x[50:120] = x[50]  # a group of copies
    x[200:290] = x[200] + rng.normal(size=(90, 16)).astype(np.float32) * 1e-3  # a group of nearly equal vectors
    made = [(i, v.tolist(), "extra") for i, v in enumerate(x)]
    made += [made[20]] * 3 + [made[60]] * 2 + [(40, x[41].tolist(), "another vector of the same id"), (301, x[300].tolist(), "")]
    odd = [(400, None, ""), (401, [0.0] * 16, ""), (402, [float("nan")] + [1.0] * 15, ""), (403, [1.0, 2.0], ""), (404, [None] * 16, ""), (None, [1.0] * 16, "")]
    df = spark.createDataFrame([*made, *odd], "vec_id long, embedding array<float>, score string")
    monkeypatch.setattr(ann, "BLOCK_VECTORS", 400 // blocks)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 400 // blocks)
    truth = exact_neighbours([(i, v) for i, v, _ in made], 10)
    is_query = F.col("vec_id") % 20 == 0
    compare_neighbours(ann.nearest(df, is_query, k=10).collect(), truth, 0.98)
    compare_neighbours(ann.nearest(df, is_query, k=10, exact=True, books=3).collect(), truth, 1.0)
    if blocks == 1:
        assert ann.nearest(df.limit(0), F.lit(True)).collect() == []
        assert len(ann.nearest(df.where("vec_id < 5"), F.col("vec_id") == 0, k=10).collect()) == 4


def test_nearest_neighbours_of_doubles(spark):
    """Scores are those of the doubles, whatever their magnitude; of vectors that differ past single precision too."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 8)) * 10.0 ** rng.integers(-3, 4, 300)[:, None]
    x[100:140] = x[100] * (1 + 1e-10 * np.arange(40))[:, None]
    x[7] *= 1e60
    made = [(i, v) for i, v in enumerate(x.tolist())]
    df = spark.createDataFrame(made, "vec_id long, embedding array<double>")
    compare_neighbours(ann.nearest(df, F.col("vec_id") % 20 == 0, k=5).collect(), exact_neighbours(made, 5), 0.99)


def test_clustered_vectors_leave_far_blocks_unvisited(spark, monkeypatch):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(12, 24)) * 4
    made = [(i, (centres[i % 12] + rng.normal(size=24) * 0.3).tolist()) for i in range(1_200)]
    monkeypatch.setattr(ann, "BLOCK_VECTORS", 60)
    seen = []
    real = common.materialize
    monkeypatch.setattr(common, "materialize", lambda df, label: seen.append((label, real(df, label))) or seen[-1][1])
    df = spark.createDataFrame(made, "vec_id long, embedding array<double>")
    compare_neighbours(ann.nearest(df, F.col("vec_id") % 20 == 0, k=10).collect(), exact_neighbours(made, 10), 0.99)
    visits = [d.count() for label, d in seen if label == "visits"]
    assert sum(visits) < 0.6 * 60 * 20


def test_quantiser_shortlists_hold_the_nearest():
    """Vectors without structure are the hardest: 32 codebooks still keep nearly all true neighbours in a shortlist of 1 %."""
    x = np.random.default_rng(3).normal(size=(8_000, 64)).astype(np.float32)
    model = ann.AdditiveQuantiser.fit(x[:4_000])
    codes, scale, *_ = zip(*(model.encode(x[lo : lo + 500]) for lo in range(0, len(x), 500)), strict=True)
    near = model.scores(x[:100], np.concatenate(codes), np.concatenate(scale))
    exact = x[:100].astype(np.float64) @ x.T.astype(np.float64)
    hit = sum(len(set(np.argsort(-a)[:80].tolist()) & set(np.argsort(-e)[:20].tolist())) for a, e in zip(near, exact, strict=True))
    assert hit >= 0.97 * 20 * 100


def test_language_id(spark, empty):
    rng = np.random.default_rng(6)
    letters = {"aa": "abcdefg", "bb": "hijklmn", "cc": "opqrstu"}
    made = []
    for i in range(300):
        lang = list(letters)[i % 3]
        made.append((i, " ".join("".join(rng.choice(list(letters[lang]), 5)) for _ in range(rng.integers(3, 30))), None if i % 11 == 0 else lang))
    made += [(900, None, "aa"), (901, "", "aa"), (902, "123 !!", "bb"), (903, "日本", None), (904, "x", None)]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string")
    held_out = common.fold(F.col("doc_id"), 5) == 0
    model = language_id.learn_languages(df, ~held_out)
    found = {r.doc_id: r for r in language_id.identify(df, model).collect()}
    assert all(found[i].lang_pred == list(letters)[i % 3] for i in range(300))
    assert [found[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and found[903].lang_pred in letters
    assert all(0 <= r.score <= 1 for r in found.values())
    nothing = language_id.learn_languages(empty, F.lit(True))
    assert {r.lang_pred for r in language_id.identify(df, nothing).collect()} == {"und"}


def plain_languages(made, rho=0.4):
    """Predictions from sets of trigrams: (language, share by language) of each text with a letter."""
    grams = lambda t: (lambda x: [x[k : k + 3] for k in range(len(x) - 2)])(b" " + low(t).encode() + b" ")
    counts = defaultdict(Counter)
    for i, text, lang in made:
        if text is not None and lang is not None and zlib.crc32(b"" if i is None else str(i).encode()) % 5:
            counts[lang].update(grams(text))
    langs = sorted(counts)
    total = {x: sum(counts[x].values()) for x in langs}
    best = {g: max(counts[x][g] / total[x] for x in langs) for x in langs for g in counts[x]}
    held = {x: {g for g, n in counts[x].items() if n / total[x] >= rho * best[g]} for x in langs}
    out = []
    for _, text, _ in made:
        if not any(c.isalpha() for c in text or ""):
            out.append(("und", 0.0))
            continue
        shares = [sum(g in held[x] for g in grams(text)) / len(text.encode()) for x in langs]
        at = max(range(len(langs)), key=lambda k: (shares[k], -k)) if sum(shares) else max(range(len(langs)), key=lambda k: (total[langs[k]], -k))
        out.append((langs[at], min(1, shares[at]) / sum(min(1, x) for x in shares) if sum(shares) else 0.0))
    return out


@pytest.mark.parametrize("own_places", [True, False])
def test_language_id_against_sets(spark, monkeypatch, own_places):
    """With a place for every trigram the filter is the sets; with hashed places it all but is."""
    rng = np.random.default_rng(16)
    letters = ["abcdefgñ", "defghijé", "ghijklmß"]
    made = [(i, " ".join("".join(rng.choice(list(letters[i % 3]), 5)) for _ in range(rng.integers(1, 30))), None if i % 11 == 0 else f"l{i % 3}") for i in range(300)]
    made += [made[4], made[4], (None, "ABC def", "l0"), (900, None, "l0"), (901, "", "l0"), (902, "12 !!", "l1"), (903, "日本", None), (904, "x", None), (905, "def ghi " * 20_000, "l1")]
    df = spark.createDataFrame([(*r, "x", 0.5) for r in made], "doc_id long, text string, lang string, lang_pred string, score double").repartition(3)
    if own_places:
        monkeypatch.setattr(language_id, "_SPARE", 1 << 20)
    model = language_id.learn_languages(df, common.fold(F.col("doc_id"), 5) != 0)
    assert model.own_places == own_places
    key = lambda i, p: (-1 if i is None else i, p)
    found = sorted((key(r.doc_id, r.lang_pred), r.score) for r in language_id.identify(df, model).collect())
    expected = sorted((key(i, p), x) for (i, _, _), (p, x) in zip(made, plain_languages(made), strict=True))
    if own_places:
        assert [k for k, _ in found] == [k for k, _ in expected]
        assert [x for _, x in found] == pytest.approx([x for _, x in expected], abs=1e-9)
    else:  # a false trigram can turn a text of a few words
        same = [abs(a[1] - b[1]) < 0.03 for a, b in zip(found, expected, strict=True) if a[0] == b[0]]
        assert len(same) >= 0.98 * len(found) and sum(same) >= 0.97 * len(found)


def test_filter_has_no_false_negatives():
    one = language_id.LanguageFilter(["a", "b"], 1 << 12, 4, 0)
    codes = np.arange(0, 2_000, 7, dtype=np.uint32)
    for at in one.positions(codes):
        np.bitwise_or.at(one.slices[0], at, np.uint64(2))
    assert ((one.finish().lookup(codes)[0] >> np.uint64(1)) & np.uint64(1)).all()


def test_lm_scores(docs, empty):
    held_out = common.fold(F.col("doc_id"), 10) == 0
    found = lm_score.lm_scores(docs, ~held_out, heads=8, buckets=4).collect()
    fold = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    tokens = [([*WORD.findall(low(r[1])), None], fold(r[0]), r[0]) for r in rows()]
    c = Counter(w for t, held, _ in tokens if not held for w in t)
    n, v = sum(c.values()), len(c)
    base = lambda t: sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
    expected = sorted(((i is not None, i or 0), len(t), sum(c[w] > 0 for w in t), n, round(base(t), 6)) for t, _, i in tokens)
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == expected
    assert all(r.score <= 0 and math.isfinite(r.score) for r in found)
    assert lm_score.lm_scores(empty, F.lit(True)).collect() == []
    untrained = lm_score.lm_scores(docs, F.lit(False)).collect()
    assert {r.train_tokens for r in untrained} == {0} and all(r.n_known == 0 for r in untrained)


def test_lm_scores_against_a_plain_model(spark, docs, monkeypatch):
    """The scores are those of the fitted parameters, word by word; in any context the probabilities of all tokens add up to one."""
    made, real = [], lm_score.fit_units
    monkeypatch.setattr(lm_score, "fit_units", lambda *a, **o: made.append(real(*a, **o)) or made[-1])
    train = common.fold(F.col("doc_id"), 10) != 0
    found = lm_score.lm_scores(docs, train, heads=8, buckets=4, vocabulary=60, size=6).collect()
    units, total, distinct = made[0]
    model = units.model
    c = Counter()
    for r in rows():
        if zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 10:
            c.update(WORD.findall(low(r[1])))
            c[" "] += 1
    assert (sum(c.values()), len(c)) == (total, distinct) and len(units.words) == 60
    assert all(n == c[w.decode()] for w, n in zip([*model.heads, *units.words], units.counts, strict=True))

    def log_p(u, v, word):
        """Of a word after the units u, v; None is a bucket's unknown token (then ``word`` is (None, bucket))."""
        unknown = isinstance(word, tuple)
        w = units.first_rest + word[1] if unknown else units.unit_of(word.encode())
        k = units.class_of_unit
        out = float(model.table[k[u], k[v], k[w]])
        if (bucket := units.bucket_of[w]) >= 0:
            r = units.far * units.R[u] + units.near * units.R[v]
            scores = {m: float(r @ units.Q[m] + units.b[m]) for m in np.flatnonzero(units.bucket_of == bucket).tolist()}
            out += scores[w] - math.log(sum(map(math.exp, scores.values())))
        if w >= units.first_rest:
            i = w - units.first_rest
            n = 0 if unknown else c[word]
            out += math.log((n if n else units.once[i]) / (units.rest[i] + units.once[i]))
        return out

    rng = np.random.default_rng(1)
    for _ in range(4):
        u, v = rng.integers(0, units.start + 1, 2)
        assert sum(math.exp(log_p(u, v, w)) for w in [*c, *((None, b) for b in range(4))]) == pytest.approx(1, abs=1e-4)
    expected = []
    for r in rows():
        u = v = units.start
        score = 0.0
        for word in [*WORD.findall(low(r[1])), " "]:
            score += log_p(u, v, word) / math.log(10)
            u, v = v, units.unit_of(word.encode())
        expected.append(((r[0] is not None, r[0] or 0), score))
    got = sorted(((r.doc_id is not None, r.doc_id or 0), r.score) for r in found)
    assert [k for k, _ in got] == [k for k, _ in sorted(expected)]
    assert [x for _, x in got] == pytest.approx([x for _, x in sorted(expected)], rel=1e-4)


def test_units_learn_from_their_contexts(spark):
    """Held-out text whose words depend on the one before, within classes: far better than the base and than counts by class."""
    rng = np.random.default_rng(5)
    pairs = {f"{a}xxx": [f"{b}yyy" for b in rng.choice(list("abcdefghijklmnop"), 2, replace=False)] for a in "abcdefghijklmnop"}
    made = [(i, " ".join(f"{a} {pairs[a][int(rng.integers(0, 2))]}" for a in rng.choice(list(pairs), 40))) for i in range(1500)]
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(2)
    held_out = common.fold(F.col("doc_id"), 10) == 0
    score, base, _ = lm_score.lm_scores(df, ~held_out, heads=1, buckets=3, vocabulary=100, size=12).where(held_out).agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    # One of 16 words, then one of two: an ideal model needs log10(16) + log10(2) for two words, which is half of the base.
    assert score > 0.65 * base


def test_log_bilinear_is_normalised_and_learns():
    rng = np.random.default_rng(0)
    model = lm_score.LogBilinear([b" ", b"a", b"b"], 1, {}, 8)
    follows = {0: 1, 1: 2, 2: 1}
    w = [1]
    for _ in range(4000):
        w.append(follows[w[-1]] if rng.random() < 0.9 else int(rng.integers(0, 3)))
    triples = Counter(zip(w, w[1:], w[2:], strict=False))
    u, v, x = (np.array(a) for a in zip(*triples, strict=True))
    model.train(u, v, x, np.array(list(triples.values())))
    assert np.exp(model.table).sum(2) == pytest.approx(np.ones((5, 5)), abs=1e-4)
    assert np.exp(model.table[1, 1, 2]) > 0.7


def plain_toxicity(model, text):
    """A document's score and spans (in ASCII characters) by enumeration of all labellings."""
    words = [m for m in re.finditer("[0-9a-z]+", low(text))]
    e = [model.emission(m.group().encode()) for m in words]
    into, out, stay = model.transition
    mass = np.zeros((len(e), 2))
    for code in range(1 << len(e)):
        s = [code >> i & 1 for i in range(len(e))]
        w = math.exp(sum(x for x, y in zip(e, s, strict=True) if y)) * (into if s and s[0] else 1)
        for a, b in zip(s, s[1:], strict=False):
            w *= {(0, 0): 1, (0, 1): into, (1, 0): out, (1, 1): stay}[a, b]
        for i, y in enumerate(s):
            mass[i, y] += w
    p = mass[:, 1] / mass.sum(1)
    top = min(max(math.log(max(p / (1 - p))), toxicity.NO_LOGIT), -toxicity.NO_LOGIT) if len(e) else toxicity.NO_LOGIT
    a, b, c = model.scale
    score = 1 / (1 + math.exp(-(a + b * top + c * math.log(max(p.sum(), toxicity.NO_WORDS)))))
    spans: list[list[int]] = []
    for i in np.flatnonzero(p >= 0.5).tolist():
        if i and p[i - 1] >= 0.5:
            spans[-1][1] = words[i].end()
        else:
            spans.append([words[i].start(), words[i].end()])
    return score, spans


def test_toxicity(spark, docs, empty, monkeypatch):
    rng = np.random.default_rng(3)
    plain = ["".join(rng.choice(list("abcdeghiklmnorst"), rng.integers(2, 8))) for _ in range(400)]
    bad = ["zzbad", "zzworse", "zzworst"]
    made, labels = [], []
    for i in range(400):
        text = list(rng.choice(plain, 40))
        if toxic := i % 5 == 0:
            for at in rng.integers(0, 40, 3):
                text[at] = f"{rng.choice(bad)}{rng.choice(list('abc'))}"
        made.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    labels += [(9999, 1), (None, 1), (3, None)]
    df = spark.createDataFrame([*made, (1000, None), (1001, "")], "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn_toxicity(df, marks, common.fold(F.col("doc_id"), 4) != 2)
    found = {r.doc_id: r for r in toxicity.toxicity(df, model).collect()}
    wrong = [i for i in range(400) if found[i].predicted != (i % 5 == 0)]
    assert len(wrong) <= 4
    assert found[1000].predicted == found[1001].predicted == 0 and all(0 <= r.score <= 1 for r in found.values())
    marked = [made[i][1][a:b] for i in range(0, 400, 5) for a, b in found[i].spans]
    assert sum("zz" in m for m in marked) > 0.9 * len(marked) > 100
    assert toxicity.toxicity(empty, model).collect() == []
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(rows())
    none = toxicity.learn_toxicity(df, marks.limit(0), F.lit(True))
    assert none is None and {r.score for r in toxicity.toxicity(docs, none).collect()} == {0.0}
    # Scores of short documents by adding up all labellings.
    short = [(i, " ".join(t.split()[: i % 9])) for i, t in made[:120]] + [(500, "ZZBADa, zzworstb!"), (501, None)]
    got = {r.doc_id: r for r in toxicity.toxicity(spark.createDataFrame(short, "doc_id long, text string"), model).collect()}
    for i, text in short:
        score, spans = plain_toxicity(model, text or "")
        assert got[i].score == pytest.approx(score, rel=1e-9) and got[i].predicted == (score >= 0.3) and [list(s) for s in got[i].spans] == spans
    # Very long texts in the sample, and a sample bounded by its bytes.
    long = df.withColumn("text", F.when(F.col("doc_id") % 50 == 1, F.repeat(F.concat("text", F.lit(" ")), 300)).otherwise(F.col("text")))
    again = toxicity.learn_toxicity(long, marks, common.fold(F.col("doc_id"), 4) != 2)
    assert sum(r.predicted != (r.doc_id % 5 == 0) for r in toxicity.toxicity(df.where("doc_id < 400"), again).collect()) <= 8
    monkeypatch.setattr(toxicity, "MOST_BYTES", 20_000)
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic: seen.append(texts))
    toxicity.learn_toxicity(long, marks, F.lit(True))
    assert 0 < sum(map(len, seen[0])) <= 20_000


def test_chain_odds_against_enumeration():
    rng = np.random.default_rng(8)
    emission, transition = rng.normal(size=7), np.array([0.3, 1.7, 2.1])
    into, out, stay = transition
    forward, backward = toxicity.chain_odds(emission, np.array([4, 0, 3]), transition)
    for lo, n in ((0, 4), (4, 3)):
        mass = np.zeros((n, 2))
        for code in range(1 << n):
            s = [code >> i & 1 for i in range(n)]
            w = math.exp(sum(emission[lo + i] for i in range(n) if s[i])) * (into if s[0] else 1)
            for a, b in zip(s, s[1:], strict=False):
                w *= {(0, 0): 1, (0, 1): into, (1, 0): out, (1, 1): stay}[a, b]
            for i in range(n):
                mass[i, s[i]] += w
        assert (forward * backward)[lo : lo + n] == pytest.approx(mass[:, 1] / mass[:, 0])


def brute_errors(schema, value, path="", depth=0):
    """JSON Schema's complaints, of the keywords that the operator reads."""
    whole = lambda x: isinstance(x, float) and x == int(x)
    names = {bool: "boolean", int: "integer", float: "integer" if whole(value) else "number", str: "string", list: "array", dict: "object", type(None): "null"}
    t, below = names[type(value)], lambda k: f"{path}.{k}" if path else k
    if schema is False:
        return [f"unknown {path}"]
    if not isinstance(schema, dict):
        return []
    out = []
    allowed = schema.get("type")
    allowed = [allowed] if isinstance(allowed, str) else allowed
    if allowed is not None and t not in allowed and not (t == "integer" and "number" in allowed):
        out.append(f"type {path}")
    if "enum" in schema and json.dumps(value, sort_keys=True) not in [json.dumps(x, sort_keys=True) for x in schema["enum"]]:
        out.append(f"enum {path}")
    if "const" in schema and value != schema["const"]:
        out.append(f"const {path}")
    size = {"integer": value, "number": value, "string": len(value) if t == "string" else 0, "array": len(value) if t == "array" else 0}
    for name, kinds, worse in (("minimum", ("integer", "number"), -1), ("maximum", ("integer", "number"), 1), ("minLength", ("string",), -1), ("maxLength", ("string",), 1), ("minItems", ("array",), -1), ("maxItems", ("array",), 1)):
        if name in schema and t in kinds and (size[t] - schema[name]) * worse > 0:
            out.append(f"{name} {path}")
    if t == "object":
        out += [f"missing {below(p)}" for p in schema.get("required", []) if p not in value]
    if depth < chat.DEPTH:
        if t == "object":
            for k, x in value.items():
                out += brute_errors(schema.get("properties", {}).get(k, schema.get("additionalProperties", True)), x, below(k), depth + 1)
        if t == "array":
            for i, x in enumerate(value):
                out += brute_errors(schema.get("items", True), x, f"{path}[{i}]", depth + 1)
    return out


def test_chat_arguments_against_a_plain_validator(spark):
    rng = np.random.default_rng(12)
    pick = lambda xs: xs[int(rng.integers(0, len(xs)))]

    def schema(depth):
        if depth and rng.random() < 0.1:
            return pick([True, False])
        out = {}
        if rng.random() < 0.8:
            out["type"] = pick(["integer", "number", "string", "boolean", "null", "array", "object", ["string", "null"], ["integer", "object"], ["array", "object"]]) if depth else "object"
        for name, value in (("enum", [1, "a", None, [1, 2], {"b": 1}]), ("minimum", 2), ("maximum", 3), ("minLength", 1), ("maxLength", 2), ("minItems", 1), ("maxItems", 2), ("const", "a")):
            if depth and rng.random() < 0.12:
                out[name] = value
        if depth < 4:
            if rng.random() < 0.8:
                out["properties"] = {k: schema(depth + 1) for k in "abcd" if rng.random() < 0.7}
            if rng.random() < 0.4:
                out["required"] = ["a", "d"]
            if rng.random() < 0.4:
                out["additionalProperties"] = pick([True, False, {"type": "string"}])
            if rng.random() < 0.6:
                out["items"] = schema(depth + 1)
        return out

    def value(depth):
        kind = rng.integers(0, 8) if depth else 7
        if depth > 3 or kind < 5:
            return pick([1, 2.5, 4, 3.0, "a", "", "éab", True, False, None])
        return [value(depth + 1) for _ in range(rng.integers(0, 4))] if kind == 5 else {k: value(depth + 1) for k in "abcde" if rng.random() < 0.6}

    made, expected = [], {}
    for i in range(300):
        s, v = schema(0), value(0)
        made += [(i, 0, "system", json.dumps({"tools": [{"name": "f", "parameters": s}]})), (i, 1, "assistant", json.dumps({"content": None, "tool_calls": [{"id": "x", "name": "f", "arguments": v}]}))]
        expected[i] = sorted(brute_errors(s, v))
    found = chat.chat_events(spark.createDataFrame(made, "conv_id long, turn long, role string, text string")).where("kind = 'call'").collect()
    assert {r.conv_id: json.loads(r.event_json)["errors"] for r in found} == expected
    assert {r.conv_id: r.valid for r in found} == {i: not e for i, e in expected.items()}
    assert 50 < sum(map(bool, expected.values())) < 280


def test_chat_places_against_a_plain_sort(spark):
    """Random graphs of calls that need results: places as a recursive definition gives them, and no event before what it needs."""
    rng = np.random.default_rng(13)
    made, needs, answers, turns = [], {}, defaultdict(list), {}
    for conv in range(25):
        for turn in range(0, 12, 2):
            calls = []
            for j in range(2):
                name = f"{turn}-{j}"
                wanted = [f"{2 * rng.integers(0, 6)}-{rng.integers(0, 2)}" for _ in range(rng.integers(0, 3))]
                if conv % 3:  # without circles
                    wanted = [w for w in wanted if tuple(map(int, w.split("-"))) < (turn, j)]
                needs[conv, name], turns[conv, name] = wanted, turn
                calls.append({"id": name, "name": "f", "arguments": {f"a{n}": f"${w}" for n, w in enumerate(wanted)} | {"price": "$unknown"}})
            made.append((conv, turn, "assistant", json.dumps({"content": "", "tool_calls": calls})))
            for _ in range(rng.integers(0, 3)):
                name = f"{2 * rng.integers(0, 6)}-{rng.integers(0, 2)}"
                at = int(rng.integers(0, 20))
                answers[conv, name].append(at)
                made.append((conv, at, "tool", json.dumps({"tool_call_id": name, "content": "r"})))

    def place(key, above=()):
        if key in above:
            raise RecursionError
        below = [(place((key[0], w), (*above, key)), answers[key[0], w]) for w in needs[key]]
        return (max([0, *(d + 1 for (d, _), _ in below)]), max([turns[key], *(x for (_, at), got in below for x in (at, *got))]))

    expected = {}
    for key in needs:
        try:
            expected[key] = place(key)
        except RecursionError:
            expected[key] = None
    found = chat.chat_events(spark.createDataFrame(made, "conv_id long, turn long, role string, text string")).collect()
    spot = lambda r: (r.order_turn, r.order_after, r.order_index)
    calls = {(r.conv_id, r.call_id): r for r in found if r.kind == "call"}
    results = defaultdict(list)
    for r in found:
        if r.kind == "result":
            results[r.conv_id, r.call_id].append(r)
            assert r.status == "linked" and spot(r) > spot(calls[r.conv_id, r.call_id])
    assert set(calls) == set(expected)
    for key, e in expected.items():
        assert (calls[key].status == "cyclic") == (e is None)
        assert (calls[key].order_turn, calls[key].order_after) == ((turns[key], 0) if e is None else (e[1], 2 * e[0]))
        if e is not None:
            for w in needs[key]:
                assert all(spot(calls[key]) > spot(x) for x in [calls[key[0], w], *results[key[0], w]])
    assert any(e is None for e in expected.values()) and any(e and e[0] > 2 for e in expected.values())


def test_chat_events(spark):
    say = lambda **x: json.dumps(x)
    tools = say(tools=[{"name": "f", "parameters": {"properties": {"x": {"type": "integer"}, "y": {"type": "string"}, "z": {"type": "number"}}, "required": ["x"], "additionalProperties": False}}, {"name": "h"}])
    calls = [{"id": "a", "name": "f", "arguments": {"y": 'é"q', "x": 1, "z": 2}}, {"id": "b", "name": "f", "arguments": {"y": 2, "w": [1, {"b": 1, "a": 2}]}}, {"id": "c", "name": "g", "arguments": {}}, {"id": "a", "name": "f", "arguments": {"x": 1}}]
    made = [
        (1, 0, "system", tools), (1, 1, "user", "hi"), (1, 2, "assistant", say(content="ok", tool_calls=calls)), (1, 3, "tool", say(tool_call_id="a", content="r")),
        (1, 1, "tool", say(tool_call_id="b", content="early")), (1, 5, "tool", say(tool_call_id="zz", content="x")), (2, 2, "tool", say(tool_call_id="a", content="other conversation")),
        (2, 0, "assistant", "{bad json"), (2, 1, "tool", "plain"), (None, None, None, None), (2, 0, "assistant", ""), (2, 0, "assistant", ""),
    ]
    df = spark.createDataFrame([(*m, "extra") for m in made], "conv_id long, turn long, role string, text string, status string")
    found = chat.chat_events(df).collect()
    assert Counter(r.kind for r in found) == {"message": 8, "call": 4, "result": 4}
    by_call = {(r.call_id, r.order_index): r for r in found if r.kind == "call"}
    assert by_call["a", 0].status == "answered" and by_call["a", 0].valid
    assert by_call["a", 3].status == "pending" and by_call["b", 1].status == "answered" and by_call["c", 2].status == "pending"
    assert json.loads(by_call["b", 1].event_json)["errors"] == ["missing x", "type y", "unknown w"]
    assert by_call["a", 0].event_json == '{"arguments":{"x":1,"y":"é\\"q","z":2},"errors":[],"id":"a","name":"f","turn":2}'
    assert json.loads(by_call["c", 2].event_json)["errors"] == ["undeclared tool"]
    place = lambda r: (r.order_turn, r.order_after, r.order_index)
    for r in found:
        if r.kind == "result" and r.status == "linked":
            call = min((c for c in found if c.kind == "call" and c.call_id == r.call_id and c.conv_id == r.conv_id), key=place)
            assert place(r) > place(call)
    assert Counter((r.conv_id, r.status) for r in found if r.kind == "result") == {(1, "linked"): 2, (1, "orphan"): 1, (2, "orphan"): 1}
    assert chat.chat_events(df.limit(0)).collect() == []
    # Very long texts and arguments, deep ones, and ties of repeated calls.
    text, deep = "ü x" * 300_000, {"a": 1}
    for _ in range(30):
        deep = {"d": deep}
    call = {"id": "L", "name": "f", "arguments": {"x": 1, "y": text, "z": 1, "deep": deep}}
    long = [(9, 0, "system", tools.replace("false", "true")), (9, 1, "user", text), (9, 2, "assistant", say(content=text, tool_calls=[call, call])), (9, 3, "tool", say(tool_call_id="L", content=text))]
    found = chat.chat_events(spark.createDataFrame(long + long[2:], "conv_id long, turn long, role string, text string")).collect()
    assert Counter(r.kind for r in found) == {"message": 4, "call": 4, "result": 2}
    assert all(json.loads(r.event_json)["arguments"] == call["arguments"] and r.valid for r in found if r.kind == "call")
    assert Counter((r.order_index, r.status) for r in found if r.kind == "call") == {(0, "answered"): 2, (1, "pending"): 2}
    assert all(json.loads(r.event_json)["content"] == text for r in found if r.kind == "result")
