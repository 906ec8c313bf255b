"""Personal data: patterns propose spans, checks confirm them, nearby words move their score."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "national_id")
#: What a span of a kind scores by itself, and which words near it raise or lower that.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "national_id": 0.4}
RAISING = {
    "email": "mail email e-mail contact correo courriel kontakt",
    "ip": "ip host server address adresse dirección serveur login",
    "card": "card visa mastercard amex credit debit karte carte tarjeta cvv",
    "phone": "phone tel telephone mobile call fax telefon téléphone teléfono handy",
    "iban": "iban account bank konto compte cuenta bic swift",
    "national_id": "ssn social security national id ausweis sécurité dni passport",
}
LOWERING = {"ip": "version release build v", "card": "order invoice tracking isbn", "phone": "order invoice", "national_id": "part serial model order"}
RAISE, LOWER, LEAST, SURE, NEAR = 0.2, 0.2, 0.5, 0.8, 48

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match that begins inside a run of digits ends as one from the run's start does, so only starts count.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){12,}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SIGNS = re.compile(r"[0-9@]")
_WORD = re.compile(r"[^\W\d_][\w-]*")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each @ in turn: the local part reaches back to the last match's end at most."""
    floor = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            floor = domain.end()
            yield start, floor
        at = text.find("@", max(at + 1, floor))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """A proposal may have swallowed the next word; groups come off its end until the checksum holds."""
    for m in _IBAN.finditer(text):
        kept = m[0]
        while len(kept.replace(" ", "")) >= 15:
            if mod97(kept.replace(" ", "")):
                yield m.start(), m.start() + len(kept)
                break
            kept = kept[: kept.rfind(" ")] if " " in kept else ""


def _nationals(text: str) -> Iterator[tuple[int, int]]:
    for m in _NATIONAL.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield m.span()


_FINDERS = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": _ibans, "national_id": _nationals}
_RAISING = {k: frozenset(v.split()) for k, v in RAISING.items()}
_LOWERING = {k: frozenset(v.split()) for k, v in LOWERING.items()}


def _score(kind: str, text: str, start: int, end: int) -> float:
    near = {w.lower() for w in _WORD.findall(text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR // 2])}
    score = PRIOR[kind] + RAISE * bool(near & _RAISING[kind]) - LOWER * bool(near & _LOWERING.get(kind, frozenset()))
    return round(min(1.0, max(0.0, score)), 3)


def find_spans(text: str | None) -> list[Span]:
    """All spans by kind, then start. Those of the base kinds stay whatever they score; the others need LEAST."""
    if not text or not (_SIGNS.search(text)):
        return []
    found = []
    for kind in KINDS:
        if kind == "email" and "@" not in text or kind == "phone" and "+" not in text:
            continue
        spans = [Span(kind, s, e, _score(kind, text, s, e)) for s, e in _FINDERS[kind](text)]
        found += spans if kind in BASE_KINDS else [x for x in spans if x.score >= LEAST]
    return found


def _digest(spans: list[Span]) -> str:
    return ",".join(f"{x.kind}:{x.start}:{x.end}" for x in spans)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns doc_id, spans array<struct<kind, start, end, score>>, base_sha256, one row per input row.

    Spans are in code points, end exclusive, sorted by kind (as in KINDS), then start. Null and empty texts
    have none. Repeated rows and null ids stay as they are; other columns are not read.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find_spans(text) for text in batch.column(1).to_pylist()]
            base = [hashlib.sha256(_digest([x for x in s if x.kind in BASE_KINDS]).encode()).hexdigest() for s in found]
            spans = pa.array([[x._asdict() for x in s] for s in found], pa.list_(span))
            yield pa.RecordBatch.from_arrays([batch.column(0), spans, pa.array(base, pa.string())], ["doc_id", "spans", "base_sha256"])

    schema = "doc_id long, spans array<struct<kind: string, start: long, end: long, score: double>>, base_sha256 string"
    return bounded_batches(docs).select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, schema)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns doc_id and text with every span replaced by its kind in brackets; spans that overlap become one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text in batch.column(1).to_pylist():
                parts, at = [], 0
                for x in sorted(find_spans(text), key=lambda x: (x.start, -x.end)):
                    if x.start >= at:
                        parts += [text[at : x.start], f"[{x.kind}]"]
                    at = max(at, x.end)
                texts.append(None if text is None else "".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return bounded_batches(docs).select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, text string")


def span_digest(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (kind:start:end, comma-joined), scores (of the spans,
    likewise), n_sure (spans that score SURE or more)."""
    counts = [F.size(F.expr(f"filter(spans, x -> x.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    joined = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    scores = F.array_join(F.transform("spans", lambda x: x["score"].cast("string")), ",")
    sure = F.size(F.filter("spans", lambda x: x["score"] >= SURE)).cast("long")
    return found.select("doc_id", *counts, "base_sha256", joined.alias("spans"), scores.alias("scores"), sure.alias("n_sure"))
