"""What near-dedup leaves on disk, and what it shuffles to drop documents."""

import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cubiform.llm import minhash, store
from tests.llm import cases

DDL = "doc_id long, text string"


def shuffle_files(spark):
    """Name and bytes of each shuffle file there is."""
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    found = env.blockManager().diskBlockManager().getAllFiles().iterator()
    files = []
    while found.hasNext():
        files.append(found.next())
    return {f.getName(): f.length() for f in files if f.getName().startswith("shuffle_")}


def added(spark, before):
    return {k: v for k, v in shuffle_files(spark).items() if k not in before}


def texts(count, words, seed=1):
    """Different texts of random words; the last tenth repeats the first, but for the last word."""
    random.seed(seed)
    made = [" ".join(f"{random.getrandbits(64):x}" for _ in range(words)) for _ in range(count)]
    return [(i, t) for i, t in enumerate(made)] + [(count + i, t + " end") for i, t in enumerate(made[: count // 10])]


def test_near_groups_frees_disk(spark):
    before = shuffle_files(spark)
    folder = Path(store.shared_folder(spark).removeprefix("file://"))
    there = {p.name for p in folder.iterdir()} if folder.exists() else set()
    found = minhash.near_groups(spark.read.parquet(f"{cases.SF}/documents.parquet"))
    for _ in range(50):  # they are removed in the background
        if not added(spark, before):
            break
        time.sleep(0.2)
    assert not added(spark, before)
    left = {p.name.split("-")[0] for p in folder.iterdir() if p.name not in there}
    assert left <= {"rows", "classes", "labels", "least", "edges"}
    docs = cases.texts(spark)
    assert {r.doc_id: r.component_id for r in found.collect()} == cases.near_components(docs)
    assert found.count() == len(docs) and found.filter("kept").count() == found.select("component_id").distinct().count()  # read more than once


def test_drop_near_leaves_texts_where_they_are(spark):
    docs = spark.createDataFrame(texts(400, 1_000), DDL).repartition(4)
    size = docs.agg(F.sum(F.length("text"))).first()[0]
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = store.cut(docs)
        kept = minhash.drop_near(docs)
        before = shuffle_files(spark)
        rows = kept.collect()
        moved = sum(added(spark, before).values())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert sorted(r.doc_id for r in rows) == list(range(400))
    assert moved < size / 4  # the 40 that go, and few others


@pytest.mark.parametrize("most_bits", [1 << 15, 1 << 27])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_without(spark, kind, most_bits):
    random.seed(3)
    ids = [random.randrange(-(2**40), 2**40) for _ in range(30_000)]
    rows = [(i, "a") for i in ids] + [(i, "again") for i in ids[:500]] + [(None, "none")] * 3
    docs = spark.createDataFrame(rows, "id long, `_gone_held` string").select(F.col("id").cast(kind), "_gone_held")
    gone = spark.createDataFrame([(i,) for i in sorted(set(ids[:20_000]))], "id long").select(F.col("id").cast(kind))
    want = docs.join(gone, "id", "left_anti").select("id", "_gone_held")
    got = store.without(docs, "id", gone, most_bits)
    assert got.columns == docs.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert store.without(docs, "id", gone.limit(0), most_bits).count() == len(rows)
    assert store.without(docs.limit(0), "id", gone, most_bits).count() == 0
