"""Ranks and scratch tables."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidelog.plans.ranks import global_rank, rank_sorted, rank_within
from tidelog.plans.scratch import drop, keep, sweep


@pytest.fixture
def rows(spark):
    """Two thirds of the rows have one key; some keys are null."""
    key = F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 5))
    return spark.range(500).select("id", key.alias("k"), (F.col("id") % 4).alias("w")).repartition(5)


def test_rank_within(rows):
    found = rank_within(rows, ["k"], [F.col("id")], 8, F.col("id"), "r").collect()
    by = Counter(r["k"] for r in found)
    for k, n in by.items():
        assert sorted(r["r"] for r in found if r["k"] == k) == list(range(n))


def test_weighted_rank_within(rows):
    found = rank_within(rows, ["k"], [F.col("id")], 8, F.col("id"), "r", weight="w").collect()
    for k in {r["k"] for r in found}:
        at = 0
        for r in sorted((r for r in found if r["k"] == k), key=lambda r: (r["id"] % 8, r["id"])):
            assert r["r"] == at
            at += r["w"]


def test_rank_sorted_and_global(rows):
    found = rank_sorted(rows, ["k"], ["w", "id"], "r", parts=6).collect()
    for k in {r["k"] for r in found}:
        own = sorted((r for r in found if r["k"] == k), key=lambda r: r["r"])
        assert [r["r"] for r in own] == list(range(len(own))) and own == sorted(own, key=lambda r: (r["w"], r["id"]))
    whole = sorted(global_rank(rows, ["k", "id"], "r", parts=6).collect(), key=lambda r: r["r"])
    assert [r["r"] for r in whole] == list(range(500))
    assert whole == sorted(whole, key=lambda r: (r["k"] is None, r["k"] or "", r["id"]))


def test_scratch_tables(spark, rows):
    kept = keep(rows, "test")
    assert kept.dtypes == rows.dtypes and kept.count() == 500
    assert "Exchange" not in kept._jdf.queryExecution().toString()
    drop(kept)
    with pytest.raises(Exception, match="exist|FILE_NOT_EXIST"):
        spark.read.parquet(kept._tidelog_path)
    assert sweep(spark) == 0


def test_running_sums_of_a_hot_key(rows):
    found = rank_sorted(rows, ["k"], [F.desc("id")], "s", weight="w").collect()
    for k in {r["k"] for r in found}:
        at = 0
        for r in sorted((r for r in found if r["k"] == k), key=lambda r: -r["id"]):
            at += r["w"]
            assert r["s"] == at


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join(spark, rows, how):
    from tidelog.plans.skew import spread_join

    keyed = rows.where("k is not null and k != 'k1'").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top")).unionByName(spark.createDataFrame([("none", 9, 1)], "k string, n long, top long"))
    plain = rows.join(keyed.drop("n"), "k", how)
    found = spread_join(rows, keyed, ["k"], "n", F.col("id"), how, least=10)
    assert found.columns == plain.columns and sorted(map(repr, found.collect())) == sorted(map(repr, plain.collect()))
    assert "__salt" in found._jdf.queryExecution().optimizedPlan().toString()
    assert spread_join(rows, keyed.limit(0), ["k"], "n", F.col("id"), how).count() == plain.sparkSession.createDataFrame([], rows.schema).count() + (rows.count() if how in ("left", "left_anti") else 0)


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from tidelog.plans.scratch import shared_dir

    unset = SimpleNamespace(get=lambda *_: None)
    with pytest.raises(ValueError, match="share"):
        shared_dir(SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(getConf=lambda: unset, master="spark://x:7077")))


def test_a_sketch_loses_no_row_and_lets_few_others_through(spark, monkeypatch):
    import tidelog.plans.sketch as sketch

    rows = spark.range(40_000).select(F.col("id").alias("a"), F.when(F.col("id") % 50 > 0, F.col("id") * 7).alias("b"), F.lit("wide").alias("t"))
    keyed = rows.where("a % 8 = 0 and b is not null").select("a", "b")
    for most, others in ((sketch.MOST_BITS, 0.1), (sketch.ROW, 0.2)):  # a full sketch lets more through
        monkeypatch.setattr(sketch, "MOST_BITS", most)
        found = sketch.sifted(rows, keyed, ["a", "b"], keyed.count())
        assert found.columns == rows.columns
        got = [(r["a"], r["b"]) for r in found.collect()]
        wanted = {(r["a"], r["b"]) for r in keyed.collect()}
        assert len(got) == len(set(got)) and wanted <= set(got) and len(got) - len(wanted) < others * 35_000
    assert sketch.sifted(rows, keyed.limit(0), ["a", "b"], 0).count() == 0 and sketch.sifted(rows.limit(0), keyed, ["a", "b"], 9).count() == 0
