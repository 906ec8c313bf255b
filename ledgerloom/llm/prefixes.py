"""Token counts of all prefixes of a word by dynamic programming, in time in step with its length.

A sequence of tokens is what merging by rank makes of its text if, and only if, each two neighbours are what it makes
of theirs. So the tokens of a prefix are those of a shorter one and one token more, the only one that ends there and
goes with the last token before it; which that is hangs on a few tokens of the vocabulary. The last character of a
prefix carries the mark of a word's end, so the token that ends it is sought among those with the mark.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import regex

#: Fixed value: the split pattern that belongs to the vocabulary; a contraction is split off before its letters are.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def settled(word: str) -> bool:
    """Whether normalising leaves each character by itself: none that joins the one before it."""
    return all(unicodedata.category(c)[0] in "LNPS" and not "ᄀ" <= c <= "ᇿ" and unicodedata.is_normalized("NFC", c) for c in word)


class Merges:
    """The merges of a vocabulary whose words end with a mark."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        self.mark = held["model"]["end_of_word_suffix"]
        self.special = [t["content"] for t in held["added_tokens"]]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in held["model"]["merges"])
        self.rank = {tuple(p): i for i, p in enumerate(pairs)}
        self.vocabulary = set(held["model"]["vocab"])
        self.longest = max(len(t.removesuffix(self.mark)) for t in self.vocabulary)
        # The printable characters that stand for bytes: those that are so themselves, the others from 256 on.
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = iter(range(256, 512))
        self.shown = {b: chr(b if b in own else next(others)) for b in range(256)}
        self.pairs: dict[tuple[str, str], bool] = {}

    def symbols(self, token: str) -> list[str]:
        bare = token.removesuffix(self.mark)
        return [*bare[:-1], bare[-1] + token[len(bare) :]]

    def merged(self, symbols: list[str]) -> list[str]:
        while len(symbols) > 1:
            rank, at = min((self.rank.get(p, len(self.rank)), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)))
            if rank == len(self.rank):
                break
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
        return symbols

    def fits(self, a: str | None, b: str) -> bool:
        """Whether b may follow a (or begin, for None)."""
        key = (a or "", b)
        if key not in self.pairs:
            if len(self.pairs) > 500_000:
                self.pairs.clear()
            self.pairs[key] = self.merged([*(self.symbols(a) if a else []), *self.symbols(b)]) == ([a, b] if a else [b])
        return self.pairs[key]

    def piece(self, text: str) -> list[int]:
        """Counts of the prefixes of one piece, by characters from 1; its characters are normalised one by one."""
        shown, ends = "", []
        for c in text:
            shown += "".join(self.shown[b] for b in c.lower().encode("utf-8"))
            ends.append(len(shown))
        last: list[str | None] = [None]
        count, out, wanted = [0], [], set(ends)
        for n in range(1, len(shown) + 1):
            found = {}
            for mark in ("", self.mark) if n in wanted else ("",):
                for m in range(max(0, n - self.longest), n):
                    token = shown[m:n] + mark
                    if token in self.vocabulary and (m == 0 or last[m]) and self.fits(last[m], token):
                        found[mark] = (token, count[m] + 1)
                        break
            if self.mark in found:
                out.append(found[self.mark][1])
            token, number = found.get("", (None, 0))
            last.append(token)
            count.append(number)
        if len(out) != len(text):
            raise ValueError("a prefix that no token ends")
        return out

    def prefixes(self, word: str, library) -> tuple[int, ...] | None:
        """Counts of all prefixes of a word from the empty one, or None where its characters do not stay by themselves
        or the count of the whole is not the library's."""
        if not settled(word) or any(s in word for s in self.special):
            return None
        of = lambda text: len(library.encode(text, add_special_tokens=False).ids)
        counts = [0]
        for found in _PIECES.finditer(word):
            text, before = found[0], counts[-1]
            # A contraction's beginning is no contraction, so it is asked for.
            counts += [before + of(text[:n]) for n in range(1, len(text) + 1)] if text[0] == "'" and len(text) > 1 and text[1].isalpha() else [before + n for n in self.piece(text)]
        return tuple(counts) if len(counts) == len(word) + 1 and counts[-1] == of(word) else None


@lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    return Merges(path)
