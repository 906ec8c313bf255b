"""Each stage against a brute-force version on a small table, and the whole run."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import common, stages
from ledgerloom.llm.mixing import mix
from ledgerloom.llm.toxicity import train

from .test_near_dup import edited, sets_of

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(9)
    make = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    base = make(100)
    texts = [make(rng.randrange(5, 120)) for _ in range(150)] + [edited(rng, base, 0.01) for _ in range(10)]
    texts += [texts[i] + rng.choice(["", " ", "\n"]) for i in range(40)] + [None, "", " ", "you moron scum " + make(20)]
    toxic = {i for i in range(0, 150, 6)}
    for i in toxic:
        texts[i] += " you moron . such scum"
    at = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, "en", rng.choice(["a", "b", None]), len(t or "")) for i, t in enumerate(texts)] + [(5, "repeated id here", "en", "a", 16)] * 2
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def rows_of(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=str)


def test_toxicity_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.toxicity(spark, docs, sf_dir)
    assert out.columns == docs.columns
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    want = sorted((tuple(r) for r in docs.collect() if model.score(r.text) < 0.7), key=str)
    assert rows_of(out) == want and 0 < len(want) < docs.count()


def test_exact_dedup_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.exact_dedup(spark, docs, sf_dir)
    least = {}
    for r in docs.collect():
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
        least[key] = min(r.doc_id, least.get(key, r.doc_id))
    got = out.collect()
    assert out.columns == docs.columns
    assert sorted((re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r.doc_id) for r in got) == sorted(least.items())


def test_near_dedup_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()
    rows = sorted(docs.distinct().collect(), key=lambda r: r.doc_id)
    sets = [sets_of(r.text) for r in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if x == old else x for x in root]
    want = [tuple(r) for i, r in enumerate(rows) if root[i] == i]
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)


def test_mixing_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.mixing(spark, docs, sf_dir)
    assert out.columns == docs.columns
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    want = {}
    for r in mix(docs).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    taken, texts = {}, {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(words(r.text))
    for r in out.collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(words(r.text))
        assert r.n_chars == len(r.text)
        assert any(set(words(r.text)) <= set(t) for t in texts[r.doc_id])
    assert taken == {k: v for k, v in want.items() if v}


def test_whole_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.count() > 0 and out.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]


def test_empty_tables(spark, sf_dir, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_columns_of_any_name(spark):
    """The stages' own columns give way to those of the table."""
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(i, t, "s", len(t or ""), f"k{i}", i, "x", i) for i, t in enumerate([text, text + " ", "other words", None, "other words"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, key string, turn int, _key string, spans int")
    for stage, ids in ((stages.drop_copies, {0, 1, 2, 3}), (stages.drop_near_copies, {0, 2, 3}), (stages.take_mix, {0, 1, 2, 4})):
        out = stage(docs).collect()
        assert {r.doc_id for r in out} == ids
        assert all((r.key, r.turn, r["_key"], r.spans) == (f"k{r.doc_id}", r.doc_id, "x", r.doc_id) for r in out)


def test_small_tables_are_spread_and_stage_tables_forgotten(spark, sf_dir):
    one = spark.range(0, 100, 1, 1)
    assert common.spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    many = spark.range(0, 100, 1, 64)
    assert common.spread(many) is many
    since = common.written(spark)
    tables = [common.cut(one, "test") for _ in range(3)]
    common.forget(spark, since)
    assert common.written(spark) == since + 1 and tables[2].count() == 100
    with pytest.raises(Exception, match="(?i)not.*exist|not_found"):
        tables[0].count()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert common.table(spark, sf_dir, "documents").columns == docs.columns
