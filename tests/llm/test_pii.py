"""Spans against the patterns as stated, by plain regular expressions."""

import hashlib
import random
import re

import pytest

from ledgerloom.llm.pii import find_pii, find_spans, mod97, redact, span_digest

STATED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    d = [int(c) for c in d][::-1]
    return sum(n if i % 2 == 0 else sum(divmod(2 * n, 10)) for i, n in enumerate(d)) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in STATED.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            fine = {
                "email": lambda m: True,
                "ip": lambda m: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda m: 13 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda m: 9 <= len(digits) <= 15,
            }[kind](m)
            if fine:
                out.append((kind, m.start(), m.end()))
    return out


def base(text):
    return [x[:3] for x in find_spans(text) if x.kind in STATED]


def test_random_strings_agree_with_the_stated_patterns():
    rng = random.Random(5)
    parts = ["a", "b@", "@", ".", "..", "-", "+", "1", "23", "255", "256", "192.168.0.1", "4539578763621486", "4539 5787 6362 1486", " ", "  ", "x@y.z", "x@y", "é", "😀", "(", ")", "+1 (988) 555-2485", "\n", "0000", "a.b+c@d-e.f.g"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert base(text) == brute(text), text


@pytest.mark.parametrize("text", [None, "", "no data here", "é" * 5])
def test_nothing_to_find(text):
    assert find_spans(text) == []


def test_added_kinds_need_their_checks():
    good = "IBAN GB82 WEST 1234 5698 7654 32 is it"
    assert [x.kind for x in find_spans(good) if x.kind == "iban"] == ["iban"]
    assert mod97("GB82WEST12345698765432") and not mod97("GB83WEST12345698765432")
    assert not [x for x in find_spans("GB83 WEST 1234 5698 7654 32") if x.kind == "iban"]
    assert [x.kind for x in find_spans("ssn 123-45-6789")] == ["national_id"]
    assert find_spans("part 123-45-6789") == []


def test_long_texts_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "+1" * 100_000, "1." * 100_000, "1 " * 100_000):
        find_spans(text)


def test_query_columns(spark):
    docs = spark.createDataFrame([(1, "a@b.co é 10.0.0.1", "x"), (2, None, "y"), (2, "", "y"), (None, "+1 (988) 555-2485", "z")], "doc_id long, text string, spans string")
    rows = {(r.doc_id, r.spans): r for r in span_digest(find_pii(docs)).collect()}
    first = rows[1, "email:0:6,ip:9:17"]
    assert (first.n_email, first.n_ip, first.n_card, first.n_phone) == (1, 1, 0, 0)
    assert first.base_sha256 == hashlib.sha256(b"email:0:6,ip:9:17").hexdigest()
    assert rows[2, ""].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert (None, "phone:0:17") in rows and len(rows) == 3
    assert span_digest(find_pii(docs.limit(0))).count() == 0


def test_redact(spark):
    docs = spark.createDataFrame([(1, "to a@b.co now"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in redact(docs).collect()} == {1: "to [email] now", 2: None}


def test_context_words_show_in_the_digest(spark):
    texts = ["call 555 at 10.0.0.1", "server 10.0.0.1", "release 10.0.0.1", "nothing", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_ip, r.scores, r.n_sure) for r in span_digest(find_pii(docs)).collect()}
    assert got == {0: (1, "0.6", 0), 1: (1, "0.8", 1), 2: (1, "0.4", 0), 3: (0, "", 0), 4: (0, "", 0)}
