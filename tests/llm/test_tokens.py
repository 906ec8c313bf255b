import random

import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from ledgerloom.llm.tokens import _SETTLED, PrefixCounts, byte_encoder, count_tokens

WORDS = Tokenizer.from_file(path("word_bpe_49k.json"))
BYTES = Tokenizer.from_file(path("byte_bpe_50k.json"))
TEXTS = ["", None, " ", "Hello, World's  don't 123 4.5", "<|endoftext|> and <|startoftext|>x", "héé Éßü Σας ΟΔΟΣ", "日本語 テキスト", "a\x1cb\x85c d e", "é ́x", "🙂🙂 ok", "x" * 3000, "tab\tnew\nline\r\n\x0b\x0c end", "'s'll 'RE I'VE"]


def tokens(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def test_counts_are_the_library_s(spark):
    rng = random.Random(1)
    alphabet = ["a", "B", "é", " ", "  ", "\n", "'", "s", "1", "22", ".", "😀", "<|endoftext|>", " ", "ſ", "\x1d", "ß"]
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(25))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(None, "a b", ""), (1, "x", "")], "doc_id long, text string, n_tokens string")
    got = count_tokens(docs, limit=5).collect()
    assert len(got) == len(texts) + 2
    for r in got[: len(texts)]:
        t = texts[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), tokens(WORDS, t), tokens(WORDS, t) > 5), t
    assert count_tokens(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["Hello, World's  don't 123 4.5 extraordinary", "  two  words ", "héé <|endoftext|> x", ""])
def test_every_prefix(text):
    counts = PrefixCounts(text)
    for n in range(len(text) + 1):
        assert counts.at(n) == tokens(WORDS, text[:n]), text[:n]
    of = [tokens(WORDS, text[:n]) for n in range(len(text) + 1)]
    for budget in range(8):
        assert counts.fitting(budget) == max(n for n, c in enumerate(of) if c <= budget)
    assert counts.fitting(-1) == 0


def test_where_documents_end_that_are_too_long(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["alpha", "beta's", "Gamma,", "x1", "ééextraordinary", "1234567"]) for _ in range(rng.randrange(12))) + rng.choice(["", " ", "\n"]) for _ in range(60)] + ["", "y" * 700]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in count_tokens(docs, limit=7).collect():
        fits = [n for n in range(len(texts[r.doc_id]) + 1) if tokens(WORDS, texts[r.doc_id][:n]) <= 7]
        assert r.fit_chars == fits[-1], texts[r.doc_id]


@pytest.mark.parametrize("made", ["letters", "mixed", "marks", "far"])
def test_every_prefix_of_long_words(made):
    rng = random.Random(made)
    alphabet = {"letters": "abcdefghinorst", "mixed": ["Ab", "é", "1", "'s", "'", "ß", "!!", "x", "İ", "Σ", "ing", "'ll", "'v", "..."], "marks": ["e", "\u0301", "a", "\u0323", "b"], "far": ["日", "本", "語", "🙂", "д", "ж", "한"]}[made]
    for size in (1, 2, 7, 40, 300):
        word = "".join(rng.choice(alphabet) for _ in range(size))
        counts = PrefixCounts(word)
        assert [counts.at(n) for n in range(len(word) + 1)] == [tokens(WORDS, word[:n]) for n in range(len(word) + 1)]


@pytest.mark.parametrize("size", [300, 3000, 9000, 50_000])
def test_where_the_limit_falls_in_a_long_word(spark, size):
    rng = random.Random(size)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(size))
    (got,) = count_tokens(spark.createDataFrame([(1, "so " + word)], "doc_id long, text string"), limit=2048).collect()
    fit = got.fit_chars
    assert got.n_tokens == tokens(WORDS, "so " + word) and got.over_limit == (got.n_tokens > 2048)
    assert tokens(WORDS, ("so " + word)[:fit]) <= 2048
    assert fit == size + 3 or all(tokens(WORDS, ("so " + word)[:n]) > 2048 for n in range(fit + 1, min(size + 3, fit + 40)))
    assert fit > 256


def test_stored_prefixes(spark):
    docs = spark.createDataFrame([(1, " é don't stop"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in count_tokens(docs, keep_prefixes=True).collect()}
    assert rows[1].word_ends == [2, 8, 13]
    assert rows[1].prefix_tokens == [tokens(WORDS, " é don't stop"[:n]) for n in (2, 8, 13)]
    assert rows[2].word_ends == [] and rows[2].n_tokens == 0


def test_byte_ids_of_all_settled_characters_are_the_library_s():
    """Texts of every character that goes by the ranks, with contractions, runs of digits and odd white space."""
    encode, rng = byte_encoder("byte_bpe_50k"), random.Random(8)
    every = [chr(c) for c in range(0x2100) if not _SETTLED.search(chr(c))]
    runs = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'S", "12345", "0" * 30, "  ", " " * 9, "\t", "\n", "\r\n", "\n\n\n", "\x0b", "\x0c", "\xa0", "\xa0\xa0 ", " \n ", "the", "ing", "don't"]
    assert len(every) > 500
    texts = ["".join(every[i : i + 7]) for i in range(0, len(every), 3)]
    texts += ["".join(rng.choice(rng.choice([every, runs, "abc xyz"])) for _ in range(rng.randrange(60))) for _ in range(4000)]
    for text in texts:
        assert encode(text).tolist() == BYTES.encode(text, add_special_tokens=False).ids, repr(text)


def test_byte_ids_are_the_library_s():
    encode = byte_encoder("byte_bpe_50k")
    for text in TEXTS:
        assert encode(text or "").tolist() == BYTES.encode(text or "", add_special_tokens=False).ids, text
