"""Toxicity by a weighted finite-state pattern grammar.

A text is a tape of symbols: clause ends, and words that are insults, threats, targets (someone addressed),
negations or reported speech; other words are left out. Five transducers rewrite the tape, each reading what the
one before has written, and weigh what they let pass: negation and reported speech weaken the insults and threats
that follow them in their clause, repetition counts less than the first, and at the end of a clause its insults
count in full only where someone is addressed, its threats only there at all. Their composition is one machine
that reads a text once; a clause's score is what it writes. Which words are insults, and how heavy, is learned
from labelled rows: whole words and word stems.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut
from .learning import bounded_sample, fold, logistic, texts_of

#: Words of the fixed transducers.
THREATS = "kill hurt destroy beat punch stab shoot burn attack töten umbringen schlagen tuer frapper matar golpear"
TARGETS = "you your yours u ya they them he she him her du dich dir euch ihr sie tu te toi vous ton votre tú ti usted vosotros ustedes"
NEGATIONS = "not never no isn't aren't wasn't don't nicht nie kein keine pas jamais aucun ni nunca jamás"
REPORTING = "said says say wrote writes called claims claimed quoted reported told sagte schrieb nannte dit écrit appelé dijo escribió llamó"
#: Labelled rows of each class that a model is fitted on, at most.
SAMPLE_TOXIC, SAMPLE_CLEAN = 4000, 12000
#: How sure a learned word must be (twice the log likelihood ratio) and how many there are at most.
SURE, MOST_TERMS, STEMS = 28.0, 4000, (4, 5, 6, 7, 8)
THRESHOLD = 0.7
#: Words whose symbol a worker remembers at most.
REMEMBERED = 100_000

_WORD = r"[^\W\d_]+(?:'[^\W\d_]+)?"
_TAPE = re.compile(_WORD + r"|[.!?;\n]")


#: What negation, reported speech, repetition and the lack of a target leave of a word's weight; a threat's weight.
DENIED, REPORTED, REPEATED, UNAIMED, THREAT = 0.4, 0.5, 0.6, 0.7, 3.0
SYMBOLS = ("insult", "threat", "target", "negation", "report", "end")

Output = tuple[tuple[str, float], ...]


class Transducer:
    """Arcs (state, symbol) -> (state, symbols written with their weights). Without an arc the state stays and the
    symbol passes with weight 1."""

    def __init__(self, start: str, arcs: dict[tuple[str, str], tuple[str, Output]]):
        self.start, self.arcs = start, arcs

    def step(self, state: str, symbol: str) -> tuple[str, Output]:
        return self.arcs.get((state, symbol)) or (state, ((symbol, 1.0),))

    def compose(self, other: Transducer) -> Transducer:
        """The machine that has `other` read what this one writes; weights multiply."""
        start, arcs, todo, seen = f"{self.start} {other.start}", {}, [(self.start, other.start)], set()
        while todo:
            pair = todo.pop()
            if pair in seen:
                continue
            seen.add(pair)
            for symbol in SYMBOLS:
                first, written = self.step(pair[0], symbol)
                second, out = pair[1], []
                for middle, weight in written:
                    second, last = other.step(second, middle)
                    out += [(name, weight * factor) for name, factor in last]
                arcs[" ".join(pair), symbol] = (f"{first} {second}", tuple(out))
                todo.append((first, second))
        return Transducer(start, arcs)


def _weakened(calm: str, cause: str, after: str, left: float) -> Transducer:
    """From `cause` to the clause's end, insults and threats keep `left` of their weight; the cause is read away."""
    return Transducer(calm, {(calm, cause): (after, ()), (after, cause): (after, ()), (after, "insult"): (after, (("insult", left),)), (after, "threat"): (after, (("threat", left),)), (after, "end"): (calm, (("end", 1.0),))})


def _first_counts(calm: str, kind: str, after: str) -> Transducer:
    """The first of a clause passes whole, each further one with REPEATED."""
    return Transducer(calm, {(calm, kind): (after, ((kind, 1.0),)), (after, kind): (after, ((kind, REPEATED),)), (after, "end"): (calm, (("end", 1.0),))})


def grammar() -> Transducer:
    """Writes insults and threats with their factors, and at a clause's end how much all of each count."""
    target = Transducer("apart", {("apart", "target"): ("aimed", ()), ("aimed", "target"): ("aimed", ()), ("apart", "end"): ("apart", (("insults", UNAIMED),)), ("aimed", "end"): ("apart", (("insults", 1.0), ("threats", 1.0)))})
    machine = _weakened("plain", "negation", "denied", DENIED).compose(_weakened("own", "report", "quoted", REPORTED))
    return machine.compose(_first_counts("calm", "insult", "insulted")).compose(_first_counts("mild", "threat", "armed")).compose(target)


def clause_scores(machine: Transducer, tape: Iterable[tuple[str, float]]) -> list[float]:
    """Scores above 0 of the clauses of a tape of (symbol, weight); only insults and threats have a weight."""
    arcs, state, scores = machine.arcs, machine.start, []
    held, score = {"insults": 0.0, "threats": 0.0}, 0.0
    for symbol, weight in chain(tape, [("end", 0.0)]):
        state, written = arcs[state, symbol]
        for name, factor in written:
            if name == "insult":
                held["insults"] += factor * weight
            elif name == "threat":
                held["threats"] += factor * weight
            else:
                score += factor * held[name]
        if symbol == "end":
            if score > 0:
                scores.append(score)
            held, score = {"insults": 0.0, "threats": 0.0}, 0.0
    return scores


@dataclass
class ToxicityModel:
    #: Learned words and stems (a stem ends with *) and their weights.
    terms: dict[str, float]
    #: Of the features, intercept last.
    calibration: np.ndarray

    def __post_init__(self):
        fixed = ((THREATS, "threat"), (TARGETS, "target"), (NEGATIONS, "negation"), (REPORTING, "report"))
        self.fixed = {w: (kind, THREAT * (kind == "threat")) for words, kind in fixed for w in words.split()} | dict.fromkeys(".!?;\n", ("end", 0.0))
        self.machine = grammar()
        self.known: dict[str, tuple[str, float] | None] = {}

    def symbol(self, word: str) -> tuple[str, float] | None:
        """The symbol of a word and its weight; None for a word that no transducer reads."""
        got = self.known.get(word, 0)
        if got == 0:
            weight = max([self.terms.get(word, 0.0), *(self.terms.get(word[:n] + "*", 0.0) for n in STEMS if len(word) > n)])
            got = ("insult", weight) if weight > 0 else self.fixed.get(word)
            if len(self.known) < REMEMBERED:
                self.known[word] = got
        return got

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Of the whole text: log of 1 + the clauses' scores, the highest of them, and log of 1 + their number."""
        tape = filter(None, map(self.symbol, _TAPE.findall((text or "").lower())))
        scores = clause_scores(self.machine, tape)
        return log1p(sum(scores)), max(scores, default=0.0), log1p(len(scores))

    def score(self, text: str | None) -> float:
        z = float(np.dot(self.calibration[:-1], self.features(text)) + self.calibration[-1])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _learned_terms(sample: DataFrame) -> dict[str, float]:
    """Words and stems that toxic rows hold far more often, by twice the log likelihood ratio; weights are log odds."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"\p{L}{3,}"), F.lit(0)))
    stems = F.expr("flatten(transform(words, w -> transform(filter(array(%s), n -> length(w) > n), n -> concat(substring(w, 1, n), '*'))))" % ", ".join(map(str, STEMS)))
    terms = sample.select("toxic", words.alias("words")).select("toxic", F.explode(F.array_distinct(F.concat("words", stems))).alias("term"))
    counts = terms.groupBy("term").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).filter("a >= 4 and a > b")
    n1, n0 = (sample.filter(F.col("toxic") == k).count() for k in (1, 0))
    if not n1 or not n0:
        return {}
    p = f"((a + b) / {n1 + n0}D)"
    ratio = F.expr(f"2 * (a * ln(a / ({n1} * {p})) + if(b > 0, b * ln(b / ({n0} * {p})), 0))")
    odds = F.expr(f"ln((a + 0.5D) / ({n1} - a + 0.5D)) - ln((b + 0.5D) / ({n0} - b + 0.5D))")
    best = counts.withColumn("sure", ratio).withColumn("odds", odds).filter(F.col("sure") >= SURE).filter(F.col("odds") >= 3.0)
    return {r.term: round(r.odds, 6) for r in best.orderBy(F.desc("sure"), "term").limit(MOST_TERMS).select("term", "odds").collect()}


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", sample: tuple[int, int] = (SAMPLE_TOXIC, SAMPLE_CLEAN)) -> ToxicityModel:
    """Fits on labelled rows with crc32(doc_id) mod 3 other than 1, at most `sample` toxic and clean ones."""
    seen = labels.select(F.col(id_col).alias("doc_id"), F.col(toxic_col).cast("int").alias("toxic")).filter((fold(F.col("doc_id"), 3) != 1) & F.col("toxic").isin(0, 1))
    chosen = bounded_sample(seen.filter("toxic = 1"), "toxic", sample[0]).unionByName(bounded_sample(seen.filter("toxic = 0"), "toxic", sample[1]))
    rows = texts_of(chosen, docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    rows = cut(rows.select("toxic", "text"), "labelled-texts")
    terms = _learned_terms(rows)
    model = ToxicityModel(terms, np.array([0.0, 0.0, 0.0, -3.0]))
    if not terms:
        return model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([g[k] for g in got], pa.float64()) for k in range(3))], ["toxic", "x0", "x1", "x2"])

    got = bounded_batches(rows).mapInArrow(run, "toxic int, x0 double, x1 double, x2 double").toPandas().sort_values(["toxic", "x0", "x1", "x2"])
    model.calibration = logistic(got[["x0", "x1", "x2"]].to_numpy(), got["toxic"].to_numpy(float))
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Returns doc_id, held_out (crc32(doc_id) mod 3 is 1; false for a null id), score, predicted (score >= threshold).

    One row per input row; null counts as empty, which matches no clause. Where nothing could be learned every
    text scores low and is predicted 0. Other columns are not read.
    """
    terms, calibration = model.terms, model.calibration  # at most MOST_TERMS words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ToxicityModel(terms, calibration)
        for batch in batches:
            scores = [own.score(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    rows = bounded_batches(docs).select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(fold(docs[id_col], 3) == 1, F.lit(False)).alias("held_out"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
