"""Exact tokenisation with the ``tokenizers`` library, with a bounded cache of pieces.

Both vocabularies split a text at white space, and after a letter or digit at certain
ASCII signs, before any merge; so the ids of a text are the ids of such pieces one after
the other.  Pieces recur far more often than they are new: the pieces of many texts are
found with numpy (as spans and 64-bit hashes), the different ones looked up, and only
unknown ones go to the library.  Texts with any other white space than the vocabulary's
rule allows for, and texts with one of the vocabulary's added tokens (such as an end
sign) in any case of letters, go to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array
from itertools import repeat

import numpy as np

from .text_arrays import FOLD, KEEP, SEPARATOR, chunks, mix, powers, raw_rows

#: Pieces whose ids a worker keeps; beyond that it starts afresh.
CACHE_PIECES = 1_000_000

#: ASCII signs that part from a letter or digit before them.
SIGNS = np.zeros(256, bool)
SIGNS[[ord(c) for c in ".,;:!?*$%&|#<>"]] = True
ALNUM = np.array([b < 128 and chr(b).isalnum() for b in range(256)])

_LOADED: dict[tuple[str, bool], "PieceTokenizer"] = {}


def loaded(path: str, blanks: bool) -> "PieceTokenizer":
    """The worker's tokenizer for a file, so that later tasks find its pieces."""
    if (path, blanks) not in _LOADED:
        _LOADED[path, blanks] = PieceTokenizer(path, blanks)
    return _LOADED[path, blanks]


def wide_blanks(data: np.ndarray) -> np.ndarray:
    """Places of white space beyond ASCII, and of the separators 0x1C to 0x1F."""
    at = [np.flatnonzero((data >= 0x1C) & (data <= 0x1F))]
    lead = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3))
    if len(lead):
        padded = np.append(data, [0, 0]).astype(np.int64)
        a, b, c = padded[lead], padded[lead + 1], padded[lead + 2]
        found = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        found |= (a == 0xE1) & (b == 0x9A) & (c == 0x80)
        found |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        found |= (a == 0xE2) & (b == 0x81) & (c == 0x9F)
        found |= (a == 0xE3) & (b == 0x80) & (c == 0x80)
        at.append(lead[found])
    return np.concatenate(at)


class PieceTokenizer:
    """``ids(array)`` yields, per text of an Arrow array, its ids as little-endian uint32
    bytes.  ``blanks`` says whether the vocabulary encodes white space (byte-level) or
    drops it and folds case (word ends).  NULL counts as the empty text."""

    def __init__(self, path: str, blanks: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        added = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values() if t.content]
        self.added = re.compile(b"(?=" + b"|".join(map(re.escape, added)) + b")", re.IGNORECASE) if added else None
        self.blanks = blanks
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.flat, self.start = array("I"), array("q", [0])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, data: np.ndarray, bounds: np.ndarray):
        """Spans and keys of the pieces, and the rows that are not plain."""
        n = len(data)
        apart = SEPARATOR[data]
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        before, after = np.empty(n, bool), np.empty(n, bool)
        before[0], after[-1] = True, True
        before[1:], after[:-1] = apart[:-1], apart[1:]
        before |= edge[:-1]
        after |= edge[1:]
        odd = wide_blanks(data)
        if self.added:
            odd = np.append(odd, [m.start() for m in self.added.finditer(data.tobytes())]).astype(np.int64)
        if self.blanks:
            wrong = apart & (before | after | ((data != 0x20) & (data != 0x0A)))
            odd = np.concatenate([odd, np.flatnonzero(wrong)])
        # a sign after an ASCII letter or digit, or after a letter U+00C0 to U+00FF
        letter = ALNUM[data]
        latin = np.zeros(n, bool)
        latin[1:] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        sign = np.zeros(n, bool)
        sign[1:] = SIGNS[data[1:]] & (letter | latin)[:-1]
        sign &= ~edge[:-1]
        first = ~apart & (before | sign)
        last = ~apart & after
        last[:-1] |= sign[1:]
        if self.blanks:  # a line feed is a piece of its own
            feed = data == 0x0A
            first, last = first | feed, last | feed
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        fold = KEEP if self.blanks else FOLD
        power, inverse = powers(n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((fold[data].astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
        keys = mix((sums[ends] - sums[starts]) * inverse[starts])
        spaced = np.zeros(len(starts), bool)
        if self.blanks:
            spaced = (starts > 0) & (data[starts - 1] == 0x20) & ~edge[starts]
            keys = np.where(spaced, mix(keys, 1), keys)
        rows = np.unique(np.searchsorted(bounds, odd, "right") - 1)
        return starts, ends, keys, spaced, rows

    def look_up(self, data, starts, ends, keys, spaced):
        """(ids, ids per piece)."""
        if len(self.known) > CACHE_PIECES:
            self.forget()
        different, which = np.unique(keys, return_inverse=True)
        place = np.fromiter(map(self.known.get, different.tolist(), repeat(-1)), np.int64, len(different))
        new = np.flatnonzero(place < 0)
        if len(new):
            some = np.empty(len(different), np.int64)
            some[which] = np.arange(len(which))
            raw, at = data.tobytes(), some[new]
            texts = [(" " if s else "") + raw[a:b].decode() for a, b, s in
                     zip(starts[at].tolist(), ends[at].tolist(), spaced[at].tolist())]
            place[new] = len(self.known) + np.arange(len(new))
            self.known.update(zip(different[new].tolist(), place[new].tolist()))
            for k in range(0, len(texts), 5000):
                for ids in self.encode(texts[k:k + 5000]):
                    self.flat.extend(ids)
                    self.start.append(len(self.flat))
        start = np.frombuffer(self.start, np.int64)
        begin = start[place][which]
        size = start[place + 1][which] - begin
        total = np.cumsum(size)
        flat = np.frombuffer(self.flat, np.uint32) if len(self.flat) else np.zeros(0, np.uint32)
        take = np.repeat(begin - (total - size), size) + np.arange(total[-1] if len(total) else 0)
        return flat[take], size

    def ids(self, texts):
        data, bounds = raw_rows(texts)
        for at, to in chunks(bounds):
            part, own = data[bounds[at]:bounds[to]], bounds[at:to + 1] - bounds[at]
            if not len(part):
                yield from repeat(b"", to - at)
                continue
            starts, ends, keys, spaced, odd = self.pieces(part, own)
            ids, size = self.look_up(part, starts, ends, keys, spaced)
            ends_of = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(starts, own)]
            whole = set(odd.tolist())
            for row in range(to - at):
                if row in whole:
                    text = part[own[row]:own[row + 1]].tobytes().decode()
                    yield np.array(self.encode([text])[0], np.uint32).tobytes()
                else:
                    yield ids[ends_of[row]:ends_of[row + 1]].tobytes()
