"""Operators that learn: held-out accuracy on made-up texts, and their edge cases."""

import random
import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import language, toxicity
from ledgerloom.llm.learning import bounded_sample
from ledgerloom.llm.toxicity import ToxicityModel, clause_scores, grammar

STEMS = {"en": "the and of ing tion with", "de": "der und ung keit sch mit", "fr": "le et ment eux ou ait", "es": "el y ción os que ado"}


def made(rng, lang, n):
    parts = STEMS[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    rows = []
    for i in range(600):
        lang = rng.choice(list(STEMS))
        text = made(rng, lang, rng.randrange(3, 80))
        toxic = i % 5 == 0
        if toxic:
            w = text.split()
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["moron", "zugbad" + rng.choice(["en", "er", "heit", "es"])]))
            text = " ".join(w)
        rows.append((i, text, lang, int(toxic), 0.5))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int, score double")


def test_language(spark, docs):
    model = language.train(docs)
    rows = language.identify_language(docs, model).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !!"), (None, "der und"), (2, "x" * 500_000)], "doc_id long, text string")
    got = {(r.doc_id, r.lang_pred) for r in language.identify_language(odd, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= got and len(got) == 5


def test_language_learns_nothing_from_held_out_rows(spark, docs):
    held = docs.filter("crc32(cast(doc_id as string)) % 5 = 0")
    model = language.train(held)
    assert model.languages == []
    assert {r.lang_pred for r in language.identify_language(docs, model).collect()} == {"und"}
    one = language.train(docs.filter("lang = 'fr'"))
    assert {r.lang_pred for r in language.identify_language(docs, one).collect()} == {"fr"}


def test_toxicity(spark, docs):
    model = toxicity.train(docs.drop("toxic"), docs.select("doc_id", "toxic"))
    assert "moron" in model.terms and any(t.startswith("zugb") for t in model.terms)
    truth = {r.doc_id: r.toxic for r in docs.collect()}
    rows = toxicity.score_toxicity(docs, model).collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert r.predicted == int(r.score >= 0.7)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "moron"), (2, "a" * 500_000)], "doc_id long, text string")
    assert len(toxicity.score_toxicity(odd, model).collect()) == 4
    assert model.score(None) < 0.5


def test_toxicity_without_labels(spark, docs):
    for labels in (docs.select("doc_id", "toxic").limit(0), docs.filter("crc32(cast(doc_id as string)) % 3 = 1").select("doc_id", "toxic"), docs.filter("toxic = 0").select("doc_id", "toxic")):
        model = toxicity.train(docs.drop("toxic"), labels)
        assert {r.predicted for r in toxicity.score_toxicity(docs, model).collect()} == {0}


def test_grammar_weighs_clauses():
    model = ToxicityModel({"moron": 4.0, "zugb*": 3.0}, __import__("numpy").array([1.0, 0.0, 0.0, -1.0]))
    plain, aimed = model.score("that moron"), model.score("you moron")
    denied, quoted = model.score("you are not a moron"), model.score("he said you moron")
    assert aimed > plain > denied and aimed > quoted
    assert model.score("zugbaden") > model.score("zugb") == model.score("nothing here")
    assert model.score("I will kill you") > model.score("I will kill time") == model.score("nothing")
    assert model.score("not here. moron") == pytest.approx(model.score("so here. moron"))
    # The same words in another order or clause: what negation and report reach counts, not that they are there.
    assert model.score("moron you are not") == model.score("you moron") > denied
    assert model.score("you moron he said") > quoted and model.score("he said nothing. you moron") == aimed
    assert model.score("you are no moron, he said so") > model.score("he said you are no moron")
    assert model.score("you there. that moron") < aimed and model.score("kill that. you there") == model.score("nothing")


def brute_clauses(tape):
    """Scores above 0, by looking at what stands before and around each word in its clause."""
    scores, clause = [], []
    for symbol, weight in [*tape, ("end", 0.0)]:
        if symbol != "end":
            clause.append((symbol, weight))
            continue
        score, kinds = 0.0, [s for s, _ in clause]
        for k, (s, w) in enumerate(clause):
            if s in ("insult", "threat"):
                w *= toxicity.DENIED if "negation" in kinds[:k] else 1
                w *= toxicity.REPORTED if "report" in kinds[:k] else 1
                w *= toxicity.REPEATED if s in kinds[:k] else 1
                score += w if "target" in kinds else w * toxicity.UNAIMED * (s == "insult")
        scores += [score] if score > 0 else []
        clause = []
    return scores


def test_composed_machine_against_brute_force():
    machine, weights = grammar(), {"insult": 4.0, "threat": toxicity.THREAT}
    assert len({state for state, _ in machine.arcs}) == 2**5
    for n in range(5):
        for symbols in product(toxicity.SYMBOLS, repeat=n):
            tape = [(s, weights.get(s, 0.0)) for s in symbols]
            assert clause_scores(machine, tape) == pytest.approx(brute_clauses(tape))
    rng = random.Random(1)
    for _ in range(300):
        tape = [(s, rng.random() * 5 if s in weights else 0.0) for s in rng.choices(toxicity.SYMBOLS, k=30)]
        assert clause_scores(machine, tape) == pytest.approx(brute_clauses(tape))


def test_composition_reads_what_the_first_writes():
    first = toxicity.Transducer("a", {("a", "insult"): ("b", (("threat", 0.5), ("threat", 2.0))), ("b", "end"): ("a", ())})
    second = toxicity.Transducer("x", {("x", "threat"): ("y", (("target", 3.0),)), ("y", "threat"): ("x", ())})
    both = first.compose(second)
    assert both.step("a x", "insult") == ("b x", (("target", 1.5),)) and both.step("b x", "end") == ("a x", ())
    assert both.step("a x", "threat") == ("a y", (("target", 3.0),)) and both.step("a x", "report") == ("a x", (("report", 1.0),))


def test_letters_are_of_category_l(spark, docs):
    model = language.train(docs)
    odd = spark.createDataFrame([(i, t) for i, t in enumerate(["½ ² ① 7", "٣٤", "_ -", "ª", "5 ñ"])], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in language.identify_language(odd, model).collect()}
    assert got[0] == got[1] == got[2] == "und" and got[3] != "und" != got[4]
    assert language.identify_language(odd.limit(0), model).count() == 0


def test_long_texts_are_cut_without_loss():
    rng = random.Random(2)
    texts = [made(rng, "fr", 400) + " éü", "", None, "a", made(rng, "de", 60)]
    keep = [0, 3, 4]

    def counts(group_bytes):
        out = {}
        for group in language.segments(texts, keep, group_bytes):
            for n, (buckets, sizes) in enumerate(language.grams([(piece, starts) for _, piece, starts in group])):
                at = 0
                for (i, _, _), size in zip(group, sizes, strict=True):
                    for b in buckets[at : at + size]:
                        out[i, n, int(b)] = out.get((i, n, int(b)), 0) + 1
                    at += size
        return out

    whole = counts(1 << 30)
    assert sum(whole.values()) > 1000
    for group_bytes in (1, 2, 3, 7, 100, 1000):
        assert counts(group_bytes) == whole


def test_samples_know_every_label(spark):
    rows = [(i, f"l{i % 400}") for i in range(2000)] + [(i, "hot") for i in range(2000, 6000)] + [(7, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, lang string")
    got = {}
    for r in bounded_sample(df, "lang", 3).collect():
        got.setdefault(r.lang, set()).add(r.doc_id)
    hashed = {r.doc_id: r.h for r in df.select("doc_id", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(11)), 1).alias("h")).collect()}
    want = {}
    for i, lang in rows:
        if i != 7:
            want.setdefault(lang, []).append(i)
    assert got == {k: set(sorted(v, key=lambda i: hashed[i])[:3]) for k, v in want.items()}
    assert bounded_sample(df.limit(0), "lang", 3).count() == 0


def test_repeated_labelled_ids_are_passed_over(spark, docs):
    twice = docs.unionByName(docs.filter("lang = 'de'").withColumn("lang", F.lit("xx")))
    assert "xx" not in language.train(twice).languages
    labels = docs.select("doc_id", "toxic")
    both = toxicity.train(docs.drop("toxic"), labels.unionByName(labels.filter("toxic = 1")))
    assert both.terms == {}
    assert toxicity.score_toxicity(docs.limit(0), both).count() == 0
