"""What Python workers hold."""

import sys
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tallyweave.llm import chunks, common, lm_score


def test_a_memo_of_ids_is_small():
    """Twice as many different words as a memo once held: a worker keeps 32 MB of them at most."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        one = chunks.id_memo(chunks.tokenizer_of(f.read()), "H")
    texts = [b" ".join(b"w%x" % (i * 2654435761 % (1 << 32)) for i in range(lo, lo + 10_000)) for lo in range(0, 1_000_000, 10_000)]
    assert sum(1 for _ in one.totals(texts)) == 100
    assert one.memo and sys.getsizeof(one.memo) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in one.memo.items()) < 32 << 20


def test_slices_let_memory_go_at_the_end(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "let_go", lambda: calls.append(len(rows)))
    rows = []
    for batch in common.slices(iter([pa.record_batch([pa.array(["x" * 100] * 50)], ["t"])]), 1000):
        rows += batch.column(0).to_pylist()
    assert len(rows) == 50 and calls == [0, 50]


def untrained_units():
    words = [b"the", b"of"]
    return lm_score.Units(lm_score.LogBilinear([b" "], 3, {b"aaa": 0, b"bbb": 1}, 4), words, np.array([9, 5, 4]), np.array([3.0, 2.0, 50.0]), np.array([1.0, 1.0, 20.0]), 4)


def peak_mb(f):
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1] / (1 << 20)
    finally:
        tracemalloc.stop()


def test_units_by_word_hold_no_memo_of_rare_words():
    units = untrained_units()
    names, held = lm_score._Units(units), lm_score._Units(units)
    for i in range(300_000):
        word = b"%xbbb" % i if i % 2 else b"%xz" % i
        assert names[word] == units.first_rest + (1 if i % 2 else 2)
    assert names[b" "] == 0 and names[b"of"] == units.unit_of(b"of") == 2
    assert len(names) == len(held)


def invented(n_docs, n_words):
    """A block of documents of words that are all different."""
    texts = [b" ".join(b"w%x" % (i * 2654435761 % (1 << 32)) for i in range(d * n_words, (d + 1) * n_words)) for d in range(n_docs)]
    return pa.table([pa.array(range(n_docs), pa.int64()), pa.array([d % 10 != 0 for d in range(n_docs)]), pa.array(texts, pa.binary()), pa.array([0] * n_docs, pa.int32())], ["doc_id", "train", "text", "block"])


NO_WORDS = pa.table([pa.array([], pa.binary()), pa.array([], pa.int64())], ["word", "c"])


def test_contexts_of_a_partition_are_small(monkeypatch):
    """Tokens that wait, their joined arrays and those learned from before: 36 bytes a token that waits (72 when units took eight bytes)."""
    monkeypatch.setattr(lm_score, "WAITING", 400_000)
    units = untrained_units()
    batches = [pa.record_batch([pa.array([b"the of xaaa " * 5_000], pa.binary())], ["text"])] * 80  # 1,200,080 tokens
    total, sizes = np.zeros(5 * 5 * 4, np.int64), []

    def learn():
        for u, v, w in lm_score.contexts(iter(batches), units, total):
            sizes.append(len(w))
            assert len(u) == len(v) == len(w)

    assert peak_mb(learn) < 36 * 0.4 + 2
    assert sum(sizes) == total.sum() == 80 * 15_001


def test_scores_of_a_block_are_made_by_slices():
    """Of 1,000,000 tokens of one block, 50 distinct words: what is held at once is a few bytes a token."""
    units = untrained_units()
    texts = [b" ".join(b"w%d" % (i % 50) for i in range(4_999))] * 200
    docs = pa.table([pa.array(range(200), pa.int64()), pa.array([True] * 200), pa.array(texts, pa.binary())], ["doc_id", "train", "text"])
    assert peak_mb(lambda: lm_score.score_block(docs, NO_WORDS, units, 1_000_000, 51)) < 45


@pytest.mark.parametrize("tokens", [1, 7, 100])
def test_scores_do_not_depend_on_slices(monkeypatch, tokens):
    docs, units = invented(30, 9), untrained_units()
    docs = pa.concat_tables([docs, pa.table([pa.array([90, 91], pa.int64()), pa.array([True, False]), pa.array([b"", b"the of waaa W1 " * 30], pa.binary()), pa.array([0, 0], pa.int32())], docs.column_names)])
    words = pa.table([pa.array([b"w1", b"waaa"], pa.binary()), pa.array([7, 3])], ["word", "c"])
    rng = np.random.default_rng(2)
    units.Q[:] = rng.normal(0, 0.5, units.Q.shape)
    whole, counted = lm_score.score_block(docs, words, units, 300, 280).to_pydict(), lm_score.count_block(docs).to_pydict()
    monkeypatch.setattr(lm_score, "SLICE_TOKENS", tokens)
    monkeypatch.setattr(lm_score, "SLICE_BYTES", tokens)
    cut = lm_score.score_block(docs, words, units, 300, 280).to_pydict()
    for name in ("base_score", "score"):
        assert cut.pop(name) == pytest.approx(whole.pop(name), rel=1e-5)
    assert cut == whole and lm_score.count_block(docs).to_pydict()["n"] == counted["n"]


@pytest.fixture(scope="module")
def vocabulary():
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        return chunks.tokenizer_of(f.read())


def encoded_by(one):
    """The chunks that the library is given from here on."""
    given, of_led = [], one.of_led
    one.of_led = lambda parts: given.extend(parts) or of_led(parts)
    return given


def test_a_word_before_other_marks_is_not_encoded_again(vocabulary):
    one = chunks.id_memo(vocabulary, "H")
    given = encoded_by(one)
    text = " ".join(f"x{w}{marks}" for w in ("worenly", "thblein", "ofingha") for marks in ("", ".", ",", "!!", "%%%", "!"))
    assert list(one.totals([text.encode()])) == [np.array(vocabulary.encode(text, add_special_tokens=False).ids, "<u2").tobytes()]
    assert len(given) <= 3  # the first has no space before it


def test_words_met_once_leave_room_in_a_memo(vocabulary, monkeypatch):
    monkeypatch.setattr(chunks, "MEMO_ENTRIES", 1000)
    one = chunks.id_memo(vocabulary, "H")
    list(one.totals([b" ".join(b"w%x" % (i * 2654435761 % (1 << 32)) for i in range(999))]))
    assert len(one.memo) < 100
    for _ in range(2):
        list(one.totals([b"a later word"]))
    assert {b"later", b"word"} <= one.memo.keys()


def test_ids_of_words_and_marks_are_the_librarys(vocabulary):
    rng = np.random.default_rng(5)
    special = [t.content for t in vocabulary.get_added_tokens_decoder().values()]
    parts = ["the", "Worenly", "3", "é", "ß", "١", "字", "́", "'", "'s", "’", "…", "\n", "\t", " ", " ", " ", " ", *"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", *special, *(x[:-1] for x in special), *(x[1:] for x in special)]
    texts = ["".join(rng.choice(parts, rng.integers(1, 40))) for _ in range(4000)]
    texts += [f"{a}{b}{c} {a}{b}" for a in parts for b in parts for c in (".", "'", "a", " ")]
    one = chunks.id_memo(vocabulary, "H")
    for _ in range(2):  # learned, then from the memo
        found = list(one.totals([t.encode() for t in texts]))
        assert found == [np.array(e.ids, "<u2").tobytes() for e in vocabulary.encode_batch_fast(texts, add_special_tokens=False)]


def test_what_stands_beside_a_line_end_is_not_encoded_again(vocabulary):
    one = chunks.id_memo(vocabulary, "H")
    given = encoded_by(one)
    words = ("worenly", "thblein", "ofingha", "édatsh", "unzuß")
    text = " ".join(f"{a}.\n{b}" for a in words for b in words)
    assert list(one.totals([text.encode()])) == [np.array(vocabulary.encode(text, add_special_tokens=False).ids, "<u2").tobytes()]
    assert len(given) <= 2 * len(words)  # not one for each pair


def test_ids_around_line_ends_are_the_librarys(vocabulary):
    rng = np.random.default_rng(6)
    special = [t.content for t in vocabulary.get_added_tokens_decoder().values()]
    parts = ["the", "Worenly", "7", "é", "ß", "字", "'s", "'", "…", ".", "!!", "\n", "\n", "\n", "\r\n", "\n\n", "\t", "\x0b", "\x85", "\u00a0", "\u2028", "\u3000", " ", " ", " ", *special, *(x[:-1] for x in special)]
    texts = ["".join(rng.choice(parts, rng.integers(1, 40))) for _ in range(4000)]
    texts += ["".join((a, b, c, d, e)) for a in ("", " ", "x", "x.") for b in parts for c in ("\n", "\n.\n") for d in parts for e in ("", " y")]
    one = chunks.id_memo(vocabulary, "H")
    for _ in range(2):  # learned, then from the memo
        found = list(one.totals([t.encode() for t in texts]))
        assert found == [np.array(e.ids, "<u2").tobytes() for e in vocabulary.encode_batch_fast(texts, add_special_tokens=False)]


def test_words_of_latin_letters_need_no_pre_tokenizer(vocabulary):
    letters = [chr(c) for c in (*range(65, 91), *range(97, 123), *range(0xC0, 0x240)) if c not in (0xD7, 0xF7)]
    assert all(chunks.LATIN(x.encode()) for x in letters)
    assert not any(chunks.LATIN(x.encode()) for x in map(chr, range(0x3000)) if not x.isalpha()) and not chunks.LATIN(b"a\xc3") and not chunks.LATIN(b"")
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(letters, rng.integers(1, 9))) for _ in range(5000)] + [f"{a}{x}b" for x in [*letters, "×", "÷", "ª", "µ", "ɏ", "ɐ"] for a in ("", "a")]
    of_led = chunks.id_memo(vocabulary, "H").of_led
    whole = vocabulary.encode_batch_fast([" " + w for w in words], add_special_tokens=False)
    assert of_led([w.encode() for w in words]) == [np.array(e.ids, "<u2").tobytes() for e in whole]
