import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.exact_dedup import exact_dedup, name_documents

SCHEMA = "doc_id long, text string, kept string, name long"


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(norm(r[1]), []).append(r[0])
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, keep, len(ids), digest) for i in ids]
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab \n\té😀") for _ in range(rng.randrange(0, 40))) for _ in range(60)]
    texts += ["x" * 50, "x" * 49, "x" * 48 + "y", "", None, " ", "\t\n"]
    return [(i, rng.choice(texts), "clash", 7) for i in range(400)] + [(5, "a  b", "clash", 1), (5, "a b", "clash", 1), (None, "a b", None, None)]


@pytest.mark.parametrize("weak", [False, True])
def test_against_brute_force(spark, rows, weak):
    # A weak key makes different blocks share keys, which takes the way by contents.
    key = (lambda b: F.length(b).cast("long")) if weak else None
    df = exact_dedup(spark.createDataFrame(rows, SCHEMA), block_chars=8, key=key)
    out = df.collect()
    assert got(df) == brute(rows)
    by_text = {}
    for r in out:
        by_text.setdefault(r.text_sha256, []).append(r)
    assert all(sum(r.kept for r in group) == 1 for group in by_text.values())
    assert all(r.doc_id == r.keep_id for r in out if r.kept)


def test_empty_table_and_long_text(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup(empty).count() == 0
    long = "lorem ipsum " * 60_000
    df = exact_dedup(spark.createDataFrame([(2, long, "", 0), (1, long + " ", "", 0), (3, long + "x", "", 0), (4, "é" + long, "", 0), (5, "é" + long, "", 0)], SCHEMA))
    assert {r.doc_id: r.keep_id for r in df.collect()} == {2: 1, 1: 1, 3: 3, 4: 4, 5: 4}


def test_plan_is_native(spark):
    df = exact_dedup(spark.createDataFrame([(1, "a", "", 0)], SCHEMA))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("weak", [False, True])
def test_names_follow_contents_and_not_partitions(spark, rows, weak):
    key = (lambda b: F.length(b).cast("long")) if weak else None
    df = spark.createDataFrame(rows, SCHEMA)
    names = [
        sorted({(r.text_sha256, r.n_blocks, r.name) for r in name_documents(df.repartition(n, "kept", "text"), block_chars=4, key=key).collect()})
        for n in (1, 7)
    ]
    assert names[0] == names[1]
    assert len({x[1:] for x in names[0]}) == len({x[0] for x in names[0]}) == len({norm(r[1]) for r in rows})


def test_names_of_single_blocks_are_in_key_order(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(300)], "doc_id long, text string")
    named = name_documents(df).join(df.select("doc_id", F.xxhash64("text").alias("key")), "doc_id").collect()
    unsigned = sorted((r.key & (2**64 - 1), r.name) for r in named)
    assert [n for _, n in unsigned] == sorted(n for _, n in unsigned) and all(n > 0 for _, n in unsigned)
