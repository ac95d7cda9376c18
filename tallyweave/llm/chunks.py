"""Byte-level BPE by chunks: what the library does with a whole text, from what it does with its pieces.

The pre-tokenizer of the byte-level vocabularies never makes a piece that holds a space after a
character that is not white space. So a text may be cut before every such space, each chunk encoded
alone by the library, and the ids joined. Chunks recur, so their ids are kept in a bounded memo.
A chunk that ends in white space isn't cut off from what follows it.

Nor does it make a piece that holds an ASCII letter or digit and, at the chunk's end, marks such as ``.`` or ``!!``
(``MARKS``) behind it. So a chunk that the memo lacks is put together from its word and its marks where it ends so.

Nor one that holds a newline after a character that is not white space. So a chunk that the memo lacks is cut before the last
such newline first: what stands on either side of a line's end recurs, the two together seldom.

A word of letters and the space before it are one piece, so its ids are the library's merges of it; the pre-tokenizer need
not find that out again.
"""

from __future__ import annotations

import re
import sys
from array import array
from codecs import charmap_decode
from collections.abc import Iterator
from contextlib import suppress
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import CharDelimiterSplit

#: Entries a memo holds before it starts anew, the longest chunk it keeps, and bytes of text cut at once.
MEMO_ENTRIES = 150_000
MEMO_CHUNK_BYTES = 96
SLICE_BYTES = 256 << 10
#: Counters of chunks seen but not kept yet: a chunk is kept when it is met again, so that those met once don't fill the memo.
SEEN = 1 << 21
#: Chunks that the library gets as one text; far longer texts cost it more.
JOINED = 256
#: ASCII that is neither letter, digit nor white space; the apostrophe, which starts pieces with letters, is left out.
MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


@lru_cache(maxsize=2)
def tokenizer_of(data: bytes) -> Tokenizer:
    """The tokenizer in a ``.json`` file's bytes, without truncation or padding."""
    found = Tokenizer.from_buffer(data)
    found.no_truncation()
    found.no_padding()
    return found


def splits_at_spaces(tokenizer_json: dict) -> bool:
    """Whether the vocabulary is of the kind that chunks are proven for."""
    pre = tokenizer_json.get("pre_tokenizer") or {}
    return (
        tokenizer_json.get("normalizer") is None
        and pre.get("type") == "ByteLevel"
        and not pre.get("add_prefix_space")
        and pre.get("use_regex", True)
        and not tokenizer_json["model"].get("dropout")
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or {" ", "\n"} & set(t["content"]) for t in tokenizer_json["added_tokens"])
    )


#: Matches words of Latin letters (ASCII, and U+00C0 to U+023F without the two signs), whatever Unicode the library knows.
LATIN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf])+").fullmatch
#: What the byte-level vocabularies write for each byte: visible ones as they are in Latin-1, others as U+0100 and on. A newline, which no word holds, stays.
VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_CHARS = "".join("\n" if b == 10 else chr(b) if b in VISIBLE else chr(256 + b - sum(v < b for v in VISIBLE)) for b in range(256))

#: White space (Unicode) in UTF-8, as a chunk may end with it.
SPACES = tuple(chr(c).encode() for c in range(0x3001) if chr(c).isspace())
SPACES_LAST = frozenset(x[-1] for x in SPACES)


class Chunks:
    """What ``total`` makes of the values of a text's chunks, for texts as bytes.

    ``of`` turns chunk texts into values; ``total`` raises TypeError on Ellipsis (``sum`` and ``b"".join`` do).
    A full memo takes nothing more until most chunks of a slice are missing from it; then it starts anew.
    """

    def __init__(self, of, total, of_led=None, marks: bytes = b"", of_lined=None):
        self.of, self.total = of, total
        #: Marks that may be cut off a chunk's end.
        self.marks = marks
        #: Values of chunks given without their leading space.
        self.of_led = of_led or (lambda parts: of([(b" " + x).decode("utf-8", "replace") for x in parts]))
        #: Values of chunks given without the newline that they start with, the only one.
        self.of_lined = of_lined or (lambda parts: of([(b"\n" + x).decode("utf-8", "replace") for x in parts]))
        #: Values by chunk without its leading space; a text's first chunk, which has none, is kept with one.
        self.memo: dict[bytes, object] = {}
        self.seen = bytearray(SEEN)

    def _learned(self, new: set[bytes]) -> tuple[dict[bytes, object], dict[bytes, object]]:
        """Values of chunks, and of those put together from others; Ellipsis for those that are empty or end in white space."""
        memo, marks, total = self.memo, self.marks, self.total
        found: dict[bytes, object] = dict.fromkeys((x for x in new if not x or x[-1] in SPACES_LAST and x.endswith(SPACES) and x != b" "), ...)
        lines, cut, rest = [], [], set()
        if found:
            new = new.difference(found)
        for x in [x for x in new if 10 in x]:
            at = x.rfind(10)
            if at > 0 and 32 < x[at - 1] < 127:
                lines.append((x, line := x[:at], after := b" " + x[at:]))
                new.remove(x)
                new.update(p for p in (line, after) if p not in memo)
        for x in new:
            if x[-1] in marks and (word := x.rstrip(marks))[-1:].isalnum():  # of bytes: ASCII alone
                cut.append((x, word, tail := b" " + x[len(word) :]))
                if word not in memo:
                    rest.add(word)
                if tail not in memo:
                    rest.add(tail)
            else:
                rest.add(x)
        led, first = [x for x in rest if x[0] != 32], [x for x in rest if x[0] == 32]
        lined, first = [x for x in first if x.rfind(10) == 1], [x for x in first if x.rfind(10) != 1]
        found.update(zip(led, self.of_led(led), strict=True))
        found.update(zip(lined, self.of_lined([x[2:] for x in lined]), strict=True))
        found.update(zip(first, self.of([x[1:].decode("utf-8", "replace") for x in first]), strict=True))
        joined = {x: total((found[a] if a in found else memo[a], found[b] if b in found else memo[b])) for x, a, b in cut}
        for x, *both in sorted(lines, key=lambda cut: len(cut[0])):  # what is put together from others comes after them
            joined[x] = total([joined[p] if p in joined else found[p] if p in found else memo[p] for p in both])
        return found, joined

    def _keep(self, found: dict[bytes, object], sights: int) -> None:
        """Chunks that were met ``sights`` times before, or share a counter with such."""
        memo, seen = self.memo, self.seen
        for x, value in found.items():
            if len(x) <= MEMO_CHUNK_BYTES:
                at = hash(x) % SEEN
                if seen[at] < sights:
                    seen[at] += 1
                elif len(memo) < MEMO_ENTRIES:
                    memo[x] = value

    def _slowly(self, parts: list[bytes]):
        """A text with parts that are empty or end in white space: they stay with the next one."""
        out = [parts[0][1:]]
        for part in parts[1:]:
            if not out[-1] or out[-1].endswith(SPACES):
                out[-1] += b" " + part
            else:
                out.append(part)
        return self.total(self.of([(b" " * (i > 0) + x).decode("utf-8", "replace") for i, x in enumerate(out)]))

    def totals(self, texts: list[bytes]) -> Iterator:
        lo = held = 0
        for hi, text in enumerate(texts, 1):
            held += len(text)
            if held >= SLICE_BYTES or hi == len(texts):
                yield from self._totals(texts[lo:hi])
                lo, held = hi, 0

    def _totals(self, texts: list[bytes]) -> Iterator:
        memo, rows, new, n = self.memo, [], set(), 0
        for text in texts:
            parts = text.split(b" ")
            parts[0] = b" " + parts[0]
            values = list(map(memo.get, parts))
            holes, at = [], -1
            with suppress(ValueError):
                while True:
                    at = values.index(None, at + 1)
                    holes.append(at)
            new.update(map(parts.__getitem__, holes))
            n += len(holes)
            rows.append((parts, values, holes))
        found, joined = self._learned(new)
        if len(memo) >= MEMO_ENTRIES and 3 * n > sum(len(x[0]) for x in rows):
            memo.clear()
            self.seen = bytearray(SEEN)
        if len(memo) < MEMO_ENTRIES:
            self._keep(found, 1)
            self._keep(joined, 2)  # which cost less to make again
        found |= joined
        for parts, values, holes in rows:
            for i in holes:
                values[i] = found[parts[i]]
            try:
                yield self.total(values)
            except TypeError:
                yield self._slowly(parts)


def packed(ids: list[int], code: str) -> bytes:
    """Ids as little-endian unsigned integers; code: ``H`` for 16 bits, ``I`` for 32."""
    out = array(code, ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def id_memo(tokenizer: Tokenizer, code: str) -> Chunks:
    """Chunks whose values are the library's ids, packed."""
    tokens = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]
    dtype = f"<u{array(code).itemsize}"

    def of(texts: list[str]) -> list[bytes]:
        return [packed(e.ids, code) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def of_all_with(start: bytes, token_start: str, ids_of):
        """Values of chunks given without ``start``, many as one text: the tokens that begin with it, the only ones, are where chunks begin."""
        starts = np.array([t.startswith(token_start) for t in tokens])

        def of_all(parts: list[bytes]) -> list[bytes]:
            out = []
            for lo in range(0, len(parts), JOINED):
                some = parts[lo : lo + JOINED]
                ids = np.array(ids_of(some), dtype)
                at = np.flatnonzero(starts[ids])
                if len(at) != len(some):
                    out += of([(start + x).decode("utf-8", "replace") for x in some])
                    continue
                raw, cuts = ids.tobytes(), (np.append(at, len(ids)) * ids.itemsize).tolist()
                out += [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            return out

        return of_all

    def by_library(start: bytes):
        return lambda parts: tokenizer.encode_batch_fast([(start + start.join(parts)).decode("utf-8", "replace")], add_special_tokens=False)[0].ids

    merges = Tokenizer(tokenizer.model)
    merges.pre_tokenizer = CharDelimiterSplit("\n")

    def by_merges(words: list[bytes]) -> list[int]:
        """A word of letters and the space before it are one piece, so the library's merges alone give its ids."""
        return merges.encode_batch_fast([charmap_decode(b" " + b"\n ".join(words), "strict", BYTE_CHARS)[0]], add_special_tokens=False)[0].ids

    of_words, of_others = of_all_with(b" ", "Ġ", by_merges), of_all_with(b" ", "Ġ", by_library(b" "))

    def of_led(parts: list[bytes]) -> list[bytes]:
        words, others = [], []
        for x in parts:
            (words if x.isalpha() or LATIN(x) else others).append(x)
        found = dict(zip(words, of_words(words), strict=True))
        found.update(zip(others, of_others(others), strict=True))
        return [found[x] for x in parts]

    added = {c for t in tokenizer.get_added_tokens_decoder().values() for c in t.content.encode()}  # a mark in one could belong to it
    return Chunks(of, b"".join, of_led, bytes(c for c in MARKS if c not in added), of_all_with(b"\n", "Ċ", by_library(b"\n")))
