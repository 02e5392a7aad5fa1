"""Byte-pair encoding by prefix dynamic programming.

For every prefix of a byte string there is exactly one token that can end its encoding.  ``ends(data)`` stores that
token for each prefix; the encoding of any prefix is read off by walking back from its end.  An appended byte only adds
entries, and an edit leaves the entries before it alone, which is what makes appends and near edits cheap and exact.

A token ``t`` that ends at a position is the right one if it starts the string, or if it may follow the token that ends
the prefix before it: two tokens may follow each other if encoding their joined bytes gives back the same two tokens.
Tokens that end at a position come from one Aho-Corasick pass over the bytes, and answers about pairs are kept.

Text is first cut by the vocabulary's own pattern (words, numbers, signs, white space), and no token crosses a cut.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import numpy as np

#: The cut pattern of the byte-level vocabularies, with the Unicode classes L and N.
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The same cuts for text whose only numbers are decimal digits, where L is what ``\w`` has besides digits and "_".
_PLAIN = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Coarser cuts at white space alone: each of these pieces is cut further without regard to its neighbours.
_COARSE = re.compile(r" ?\S+|\s+(?!\S)|\s+")

_LONG = 64  # longer coarse pieces are hardly ever seen again and aren't kept
_KEPT = 200_000  # pieces kept per worker at most; then the memory starts anew
_NEVER = 1 << 30


def _exceptions() -> re.Pattern:
    """Matches the characters that ``re`` and the Unicode classes sort differently.

    ``re`` counts as a word character whatever is alphanumeric, so numbers that aren't decimal digits (Nl, No) look like
    letters there; the class is built from the character database, by rule.
    """
    odd = []
    for i in range(0x80, 0x110000):
        c = chr(i)
        kind = unicodedata.category(c)
        word, digit = c.isalnum(), c.isdecimal()
        if (kind[0] == "L") != (word and not digit) or (kind[0] == "N") != digit:
            odd.append(i)
    runs: list[list[int]] = []
    for i in odd:
        if runs and runs[-1][1] == i - 1:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]")


class Vocabulary:
    """A rank file: one token a line, base64 and rank; the rank is the id and the priority of the merge."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes = {i: t for t, i in self.ranks.items()}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self._pairs: dict[int, bool] = {}
        for t, i in sorted(self.ranks.items(), key=lambda x: x[1]):
            if len(t) > 1:
                self.left[i], self.right[i] = self._halves(t, i)
        self._ending = ahocorasick.Automaton()
        for t, i in self.ranks.items():
            self._ending.add_word(t.decode("latin-1"), (i, len(t)))
        self._ending.make_automaton()
        self._odd: re.Pattern | None = None
        self._exact = None
        self._fine: dict[str, bytes] = {}
        self._pieces: dict[str, bytes] = {}
        self.tables: dict[str, list[int]] = {}  # of short pieces; they are never changed
        self.walked: dict[str, list[int]] = {}  # their ids

    def remembered(self, piece: str, table: list[int]) -> list[int]:
        """The table, which is kept if its piece is short."""
        if len(piece) <= _LONG:
            if len(self.tables) >= _KEPT:
                self.tables.clear()
            self.tables[piece] = table
        return table

    def _halves(self, t: bytes, rank: int) -> tuple[int, int]:
        """The two tokens whose merge makes the token."""
        found = []
        for k in range(1, len(t)):
            a, b = self.ranks.get(t[:k], _NEVER), self.ranks.get(t[k:], _NEVER)
            if a < rank and b < rank:
                found.append((a, b))
        if len(found) == 1:
            return found[0]
        fit = [x for x in found if self._follows(*x, below=rank)]
        if len(fit) != 1:
            raise ValueError(f"token {rank} is not the merge of two tokens")
        return fit[0]

    def _follows(self, a: int, b: int, below: int = _NEVER) -> bool:
        """Whether encoding the bytes of a and b, by merges of a rank less than ``below``, gives a and b again.

        Merges happen by rising rank, so undoing the later merge of the two tokens at the seam, again and again, visits
        every pair of tokens that ever met there.  If such a pair merges before either of them is merged away (at equal
        rank the one on the left is first), the seam does not hold.
        """
        text, until_a, until_b = self.bytes, below, below
        while True:
            m = self.ranks.get(text[a] + text[b])
            if m is not None and m < until_a and (m < until_b or m == until_b != below):
                return False
            split_a, split_b = a in self.left, b in self.left
            if split_a and (not split_b or a > b):
                until_a, a = a, self.right[a]
            elif split_b:
                until_b, b = b, self.left[b]
            else:
                return True

    def follows(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) > 3 * _KEPT:
                self._pairs.clear()
            known = self._pairs[key] = self._follows(a, b)
        return known

    def ends(self, data: bytes, known: list[int] | None = None) -> list[int]:
        """The last token of every prefix of ``data``, the shortest prefix first; ``known``: those of its first prefixes."""
        last = list(known or ())
        pairs = self._pairs
        # Tokens are at most as long as the longest; entries before the known ones aren't asked for again.
        for end, (token, size) in self._ending.iter(data.decode("latin-1")):
            if end < len(last):
                continue
            start = end - size
            if start < 0:
                last.append(token)
            else:
                before = last[start]
                fits = pairs.get(before << 20 | token)
                if fits is None:
                    fits = self.follows(before, token)
                if fits:
                    last.append(token)
        return last

    def walk(self, last: list[int]) -> list[int]:
        """The encoding that a table of last tokens holds."""
        out, at = [], len(last)
        while at > 0:
            token = last[at - 1]
            out.append(token)
            at -= len(self.bytes[token])
        out.reverse()
        return out

    def cuts(self, text: str) -> list[str]:
        """The pieces that are encoded one by one."""
        if text.isascii():
            return _PLAIN.findall(text)
        if self._odd is None:
            self._odd = _exceptions()
        if not self._odd.search(text):
            return _PLAIN.findall(text)
        if self._exact is None:
            import regex

            self._exact = regex.compile(CUTS)
        return self._exact.findall(text)

    def _encode_fine(self, piece: str) -> bytes:
        data = piece.encode("utf-8", "surrogatepass")
        token = self.ranks.get(data)
        ids = [token] if token is not None else self.walk(self.ends(data))
        return np.array(ids, "<i4").tobytes()

    def _encode_coarse(self, piece: str) -> bytes:
        fine, out = self._fine, []
        for x in self.cuts(piece):
            got = fine.get(x)
            if got is None:
                got = self._encode_fine(x)
                if len(x) <= _LONG:
                    if len(fine) >= _KEPT:
                        fine.clear()
                    fine[x] = got
            out.append(got)
        return b"".join(out)

    def packed(self, text: str) -> bytes:
        """The ids of the text as little-endian 32-bit integers."""
        pieces, out = self._pieces, []
        for x in _COARSE.findall(text):
            got = pieces.get(x)
            if got is None:
                got = self._encode_coarse(x)
                if len(x) <= _LONG:
                    if len(pieces) >= _KEPT:
                        pieces.clear()
                    pieces[x] = got
            out.append(got)
        return b"".join(out)

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of the text; those of null and of the empty text are an empty list."""
        return np.frombuffer(self.packed(text), "<i4") if text else np.empty(0, "<i4")

    def decode(self, ids) -> bytes:
        return b"".join(self.bytes[int(i)] for i in ids)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a rank file, loaded once a worker."""
    return Vocabulary(path)


class Encoding:
    """The encoding of one text that is appended to and edited.

    Only the pieces around a change are cut again; of a piece that grew, the prefix table goes on where it ended.
    """

    def __init__(self, vocabulary: Vocabulary, text: str = ""):
        self.vocabulary, self.pieces, self.tables = vocabulary, [], []
        self.work = 0  # prefixes computed so far
        self._replace(0, 0, text)

    def _table(self, piece: str, before: tuple[str, list[int]] | None) -> list[int]:
        short = self.vocabulary.tables.get(piece)
        if short is not None:
            return short
        data = piece.encode("utf-8", "surrogatepass")
        known: list[int] = []
        if before is not None:
            old = before[0].encode("utf-8", "surrogatepass")
            same = 0
            for a, b in zip(old, data):
                if a != b:
                    break
                same += 1
            known = before[1][:same]
        self.work += len(data) - len(known)
        return self.vocabulary.remembered(piece, self.vocabulary.ends(data, known))

    def _replace(self, first: int, last: int, text: str) -> None:
        """Cut ``text`` and put it in the place of the pieces from first up to last."""
        old = list(zip(self.pieces[first:last], self.tables[first:last]))
        pieces = self.vocabulary.cuts(text)
        have = {p: t for p, t in old}
        tables = [have[p] if p in have else self._table(p, old[k] if k < len(old) else None) for k, p in enumerate(pieces)]
        self.pieces[first:last], self.tables[first:last] = pieces, tables

    def append(self, text: str) -> None:
        self.edit(sum(map(len, self.pieces)), 0, text)

    def edit(self, at: int, removed: int, text: str) -> None:
        """Replace ``removed`` characters from ``at`` on.

        Pieces are cut again from the last coarse border before the change to the first one after it.
        """
        whole = "".join(self.pieces)
        new = whole[:at] + text + whole[at + removed :]
        start = _border_before(whole, at)
        end = _border_after(whole, at + removed)
        starts = list(accumulate(map(len, self.pieces), initial=0))[:-1]  # rising, as no piece is empty
        first, last = bisect_left(starts, start), bisect_left(starts, end)
        self._replace(first, last, new[start : end + len(new) - len(whole)])

    def ids(self) -> list[int]:
        walked, out = self.vocabulary.walked, []
        for piece, table in zip(self.pieces, self.tables):
            got = walked.get(piece)
            if got is None:
                got = self.vocabulary.walk(table)
                if len(piece) <= _LONG:
                    if len(walked) >= _KEPT:
                        walked.clear()
                    walked[piece] = got
            out += got
        return out


#: A space between two characters that aren't white space always starts a piece.
_BORDER = re.compile(r"(?<=\S) (?=\S)")


def _border_before(text: str, at: int) -> int:
    """The last border whose neighbours are all before the change."""
    k = at - 2
    while k > 0 and not (text[k] == " " and not text[k - 1].isspace() and not text[k + 1].isspace()):
        k -= 1
    return max(k, 0)


def _border_after(text: str, at: int) -> int:
    """The first border whose neighbours are all after the change."""
    found = _BORDER.search(text, at + 1) if at + 1 < len(text) else None
    return found.start() if found else len(text)
