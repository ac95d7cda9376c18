"""The pipeline's stages, each against brute force on its own input."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_operators import WORD, brute_links, low, plain_targets
from tokenizers import Tokenizer

import corpus_pipeline
from tallyweave.llm import common, decontaminate

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder of tables with toxic documents, copies, near copies and test passages among clean documents."""
    where = str(tmp_path_factory.mktemp("tables"))
    rng = np.random.default_rng(11)
    plain = ["".join(rng.choice(list("abcdeghiklmnorstu"), rng.integers(2, 8))) for _ in range(900)]
    say = lambda n: list(rng.choice(plain, n))
    items = [(i, " ".join(say(25))) for i in range(6)]
    docs, labels = [], []
    for i in range(240):
        words = say(int(rng.integers(60, 120)))
        if i % 8 == 0:
            for at in rng.integers(0, len(words), 4):
                words[at] = str(rng.choice(["zzvile", "zzgrim", "zzfoul"]))
        elif i % 8 == 1:
            words[10:10] = items[i % 6][1].split()
        docs.append([i, " ".join(words) + ".", "en", f"s{i % 5}"])
        labels.append((i, int(i % 8 == 0)))
    docs += [[1000 + i, docs[i][1], "en", "s0"] for i in range(2, 60, 7)]
    docs += [[2000 + i, docs[i][1] + " tail", "en", "s1"] for i in range(3, 60, 7)]
    docs += [[3000, items[2][1], "en", "s2"], [3001, "", "en", None], [3002, None, None, "s3"], [None, "no id here at all", "en", "s3"]]
    made = [(*d, None if d[1] is None else len(d[1])) for d in docs]
    spark.createDataFrame(made, COLUMNS).repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, steps = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(steps) == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_output"]

    def run(name, docs):
        return common.materialize(steps[name](spark, docs, tables), name)

    kept = run("toxicity", docs)
    assert kept.columns == columns
    before, after = Counter(map(tuple, docs.collect())), Counter(map(tuple, kept.collect()))
    gone = before - after
    assert not after - before
    assert sum(("zz" in (r[1] or "")) != (r in gone) for r in before) <= 3

    once = run("near_duplicates", kept)
    rows = [tuple(r) for r in kept.collect()]
    sets, _, root = brute_links([r[1] for r in rows])
    left = Counter(map(tuple, once.collect()))
    assert once.columns == columns and not left - after
    group = {}
    for r, s, at in zip(rows, sets, root, strict=True):
        if s:
            group.setdefault(at, []).append(r)
    smallest = lambda g: min((r[0] for r in g), key=lambda i: (i is not None, i or 0))
    assert Counter(r[0] for r in left.elements()) == Counter([smallest(g) for g in group.values()] + [r[0] for r, s in zip(rows, sets, strict=True) if not s])

    clean = run("decontamination", once)
    benchmark = spark.read.parquet(f"{tables}/benchmark.parquet")
    assert clean.columns == columns and not decontaminate.contamination(clean, benchmark).where("contaminated").count()
    hit = {r.doc_id for r in decontaminate.contamination(once, benchmark).where("contaminated").collect()}
    cut = [tuple(r) for r in clean.collect()]
    assert 3000 not in {r[0] for r in cut} and hit - {3000} <= {r[0] for r in cut}
    assert Counter(r for r in cut if r[0] not in hit) == Counter(r for r in left.elements() if r[0] not in hit)
    assert all(r[4] == (None if r[1] is None else len(r[1])) for r in cut)

    mixed = run("mixing", clean)
    assert mixed.columns == columns
    sizes = Counter()
    for r in cut:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    order = sorted(sizes, key=lambda x: (x is None, x or ""))
    goals = dict(zip(order, plain_targets([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))]), strict=True))
    taken, times = Counter(), Counter()
    for r in mixed.collect():
        taken[r.source] += len(WORD.findall(r.text or ""))
        times[tuple(r)] += 1
    assert set(times) <= set(cut) and max(times.values()) <= 3
    assert all(abs(taken[s] - goals[s]) <= 60 for s in order)

    found = run("token_output", mixed).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoded = lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
    expected = Counter((r.doc_id, len(e := encoded(r.text)), zlib.crc32(np.array(e, "<u4").tobytes())) for r in mixed.collect())
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == expected
    whole = corpus_pipeline.run(spark, tables).collect()
    assert Counter(map(tuple, whole)) == Counter(map(tuple, found))


def test_near_copies_go_from_a_similarity_of_five_words(spark):
    """Copies around 0.8 of 5-word shingles, most of them below 0.9 of 3-word shingles, against brute force."""
    rng = np.random.default_rng(23)
    made = []
    for i in range(40):
        base = [f"w{x}" for x in rng.integers(0, 5_000, int(rng.integers(60, 160)))]
        made.append((i, " ".join(base)))
        for k in range(3):
            text = list(base)
            for at in rng.choice(len(base), int(rng.integers(1, 5)), replace=False):
                text[at] = f"e{i}x{k}"
            made.append((100 * (k + 1) + i, " ".join(text)))
    made += [(1000, "a b c d"), (1001, "a b c d"), (1002, "a b c e"), (1003, ""), (1004, None)]

    def shingles(text, width):
        w = WORD.findall(low(text))
        return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()

    wide, narrow = ([shingles(t, width) for _, t in made] for width in (5, 3))
    alike = lambda s, i, j, percent: bool(s[i]) and bool(s[j]) and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j])
    pairs = [(i, j) for i in range(len(made)) for j in range(i) if alike(wide, i, j, 80)]
    assert sum(not alike(narrow, i, j, 90) for i, j in pairs) >= 20
    root = list(range(len(made)))
    for _ in made:
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
    smallest = {}
    for (doc, _), r in zip(made, root, strict=True):
        smallest[r] = min(doc, smallest.get(r, doc))
    docs = spark.createDataFrame([(i, t, "en", "s0", None if t is None else len(t)) for i, t in made], COLUMNS).repartition(3)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(smallest.values())


def test_stages_take_empty_tables(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, tables), name)
        assert docs.count() == 0


def test_stages_keep_columns_of_any_name(spark, tables):
    """Extra columns whose names are those that operators use inside go through every stage; so do repeated rows and ties."""
    names = ["score", "spans", "items", "_row", "_source", "_h", "_size", "_draws", "shard", "place", "_part", "_id", "_hash", "_nth", "a.b", "q`t", "rep", "text_hash", "block"]
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    docs = docs.unionByName(docs.limit(5))
    wide = docs.select("*", *(F.lit(f"x{i}").alias(n) for i, n in enumerate(names)))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        wide = common.materialize(stage(spark, wide, tables), name)
        docs = common.materialize(stage(spark, docs, tables), name)
        assert wide.columns == [*docs.columns, *names]
        assert wide.select(*(common.column(n) for n in names)).distinct().collect() == [tuple(f"x{i}" for i in range(len(names)))]
    # Which documents a mix draws goes by id, source and text alone.
    assert Counter(map(tuple, wide.select(*docs.columns).collect())) == Counter(map(tuple, docs.collect()))
    last = corpus_pipeline.STAGES[-1][1]
    assert Counter(map(tuple, last(spark, wide, tables).collect())) == Counter(map(tuple, last(spark, docs, tables).collect()))


def test_low():
    assert low("AÉz") == "aÉz"
