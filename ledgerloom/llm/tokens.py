"""Token ids and token counts of whole texts, without special tokens added, by public vocabulary files."""

from __future__ import annotations

import base64
import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .prefixes import merges

#: Words a worker remembers at most, and characters of words whose prefixes it does; past that it reckons again.
REMEMBERED, REMEMBERED_CHARS = 400_000, 20_000_000
#: Prefixes that are asked of the library together.
ASKED = 64
#: Fixed value: the split pattern that belongs to the public vocabulary.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Blocks whose letters and digits every Unicode version at hand classes alike.
_SETTLED = re.compile(r"[^\x09-\x0D\x20-\x7E\xA0-ɏ‐-‧€]")


@lru_cache(maxsize=4)
def _library(file: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(file))


class _Counts(dict):
    """Token count of a word (UTF-8, without white space), asked of the library once."""

    def __init__(self, file: str):
        super().__init__()
        self.file = file

    def __missing__(self, word: bytes) -> int:
        n = len(_library(self.file).encode(word.decode("utf-8"), add_special_tokens=False).ids)
        if len(self) < REMEMBERED:
            self[word] = n
        return n


@lru_cache(maxsize=4)
def _counts(file: str) -> _Counts:
    return _Counts(file)


class _Prefixes(dict):
    """Token counts of all prefixes of a word, by their length from 0: by dynamic programming over its pieces, or asked of
    the library for words whose characters do not stay by themselves (see prefixes.settled)."""

    def __init__(self, file: str):
        super().__init__()
        import public_tokenizers

        self.file, self.merges, self.chars = file, merges(public_tokenizers.path(file)), 0

    def __missing__(self, word: str) -> tuple[int, ...]:
        counts = self.merges.prefixes(word, _library(self.file)) or (0, *self._asked(word, range(1, len(word) + 1)))
        self.chars += len(word)
        if self.chars > REMEMBERED_CHARS:
            self.clear()
            self.chars = len(word)
        self[word] = counts
        return counts

    def _asked(self, word: str, lengths: range) -> Iterator[int]:
        for at in range(0, len(lengths), ASKED):
            got = _library(self.file).encode_batch([word[:n] for n in lengths[at : at + ASKED]], add_special_tokens=False)
            yield from (len(x.ids) for x in got)

    def at(self, word: str, n: int) -> int:
        """Tokens of the first n characters of a word."""
        return self[word][n]

    def fitting(self, word: str, budget: int) -> int:
        """The longest prefix of at most budget tokens."""
        counts = self[word]
        return next(n for n in range(len(word), -1, -1) if counts[n] <= budget)


@lru_cache(maxsize=4)
def _prefixes(file: str) -> _Prefixes:
    return _Prefixes(file)


def prefix_totals(text: bytes, file: str) -> list[int]:
    """Exact token counts of the prefixes that end with each word, 0 first.

    The vocabulary splits at white space and drops it, so the count at the end of word k is the count at
    the end of word k-1 plus that of word k. bytes.split() splits at x20 and x09-x0D and nothing else.
    """
    return list(accumulate(map(_counts(file).__getitem__, text.split()), initial=0))


class PrefixCounts:
    """Answers about every prefix of one text, from stored counts: those at its word ends, summed up along the text,
    and those of the prefixes of its words, which are the same wherever a word stands."""

    def __init__(self, text: str | None, file: str = "word_bpe_49k.json", totals: list[int] | None = None):
        self.text, self.file = text or "", file
        spans = [m.span() for m in _WORD.finditer(self.text)]
        self.starts, self.ends = [s for s, _ in spans], [e for _, e in spans]
        self.totals = prefix_totals(self.text.encode("utf-8"), file) if totals is None else totals

    def at(self, n_chars: int) -> int:
        """Tokens of the first n_chars characters."""
        k = bisect_right(self.ends, n_chars)
        if k == len(self.starts) or self.starts[k] >= n_chars:
            return self.totals[k]
        return self.totals[k] + _prefixes(self.file).at(self.text[self.starts[k] : self.ends[k]], n_chars - self.starts[k])

    def fitting(self, budget: int) -> int:
        """The longest prefix, in characters, of at most budget tokens; 0 for a budget below 0."""
        k = bisect_right(self.totals, budget) - 1
        if k < 0 or k == len(self.starts):
            return len(self.text) if k >= 0 else 0
        return self.starts[k] + _prefixes(self.file).fitting(self.text[self.starts[k] : self.ends[k]], budget - self.totals[k])


def count_tokens(docs: DataFrame, file: str = "word_bpe_49k.json", limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", keep_prefixes: bool = False) -> DataFrame:
    """Returns doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), fit_chars (characters of the longest prefix
    of at most limit tokens), and with keep_prefixes also word_ends (characters) and prefix_tokens (tokens up to
    each end), one row per input row.

    Null text counts as empty: 0 bytes, 0 tokens. Repeated rows and null ids stay as they are; other
    columns are not read. The vocabulary must drop white space, as word_bpe_49k.json does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text or b"" for text in batch.column(1).to_pylist()]
            rows = []
            for text in texts:
                totals = prefix_totals(text, file)
                chars = text.decode("utf-8")
                fit = len(chars) if totals[-1] <= limit else PrefixCounts(chars, file, totals).fitting(limit)
                more = ([m.end() for m in _WORD.finditer(chars)], totals[1:]) if keep_prefixes else ()
                rows.append((len(text), totals[-1], totals[-1] > limit, fit, *more))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names[1:])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=False))], names)

    names = ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"] + ["word_ends", "prefix_tokens"] * keep_prefixes
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long" + (", word_ends array<long>, prefix_tokens array<long>" if keep_prefixes else "")
    return bounded_batches(docs).select(docs[id_col].cast("long").alias("doc_id"), F.encode(docs[text_col], "UTF-8").alias("text")).mapInArrow(run, schema)


@lru_cache(maxsize=4)
def byte_encoder(name: str) -> Callable[[str], np.ndarray]:
    """text -> token ids (uint32) of name.json; `name` has the same vocabulary as .json and as .tiktoken ranks.

    Texts of settled Latin characters go through the ranks, which give the same ids in a third of the time;
    all others, and those that hold a special token's string, through the library of the .json file.
    """
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as file:
        special = [t["content"] for t in json.load(file)["added_tokens"]]
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding(name, pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special) or _SETTLED.search(text):
            return np.array(_library(f"{name}.json").encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(fast.encode_ordinary(text), np.uint32)

    return encode
