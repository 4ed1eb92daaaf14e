import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quality_probe.operators import ranking
from quality_probe.operators.ordering import min_ranks, number_rows, quantiles, without_slices


def frame(spark, n=3000, hot=0.4, seed=1):
    """Two groups of scores; one value holds a large share of each."""
    draw = random.Random(seed)
    rows = [
        ("ab"[i % 2], f"id{i}", 0.5 if draw.random() < hot else round(draw.random(), 2)) for i in range(n)
    ]
    return spark.createDataFrame(rows, "classifier string, id string, score double").repartition(7), pd.DataFrame(
        rows, columns=["classifier", "id", "score"]
    )


def test_numbers_match_a_sort(spark):
    df, pdf = frame(spark)
    got = without_slices(number_rows(df, ["classifier"], [F.desc("score"), "id"], total="total")).toPandas()
    pdf = pdf.sort_values(["score", "id"], ascending=[False, True])
    pdf["row_number"] = pdf.groupby("classifier").cumcount() + 1
    both = got.merge(pdf, on=["classifier", "id", "score"], suffixes=("", "_want"))
    assert len(both) == len(pdf) and (both.row_number == both.row_number_want).all()
    assert set(got.total) == {1500}


def test_hot_score_is_split_over_tasks(spark):
    df, _ = frame(spark, n=20_000, hot=0.6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbered = number_rows(df, ["classifier"], [F.desc("score"), "id"])
        slices = numbered.filter("score = 0.5").select("classifier", "_slice").distinct().groupBy("classifier").count()
        assert min(r["count"] for r in slices.collect()) >= 2
        largest = numbered.groupBy("_slice").count().agg(F.max("count")).first()[0]
        assert largest < 20_000 / 2
        got = min_ranks(numbered, ["classifier"], "score").toPandas()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = got.groupby("classifier")["score"].rank(ascending=False, method="min")
    assert (got["rank"] == want).all()


def test_min_ranks_when_one_value_fills_slices(spark):
    df = spark.range(5000).selectExpr("'a' AS classifier", "cast(id AS string) AS id", "cast(1 AS double) AS score")
    got = min_ranks(number_rows(df, ["classifier"], [F.desc("score"), "id"]), ["classifier"], "score")
    assert [r[0] for r in got.select("rank").distinct().collect()] == [1]


def test_quantiles_match_numpy(spark):
    """A hot value, values over many magnitudes, one value alone, one row alone; only counts are shuffled."""
    df, pdf = frame(spark, n=1001)
    odd = [("wide", 10.0 ** (i % 40 - 20)) for i in range(400)] + [("same", 2.5)] * 7 + [("one", -1.0), ("one", None)]
    df = df.drop("id").unionByName(spark.createDataFrame(odd, "classifier string, score double"))
    pdf = pd.concat([pdf, pd.DataFrame(odd, columns=["classifier", "score"])]).dropna(subset=["score"])
    shares = {"low": 0.001, "quarter": 0.25, "mid": 0.5, "top": 0.999, "all": 1.0, "none": 0.0}
    got = quantiles(df, "classifier", "score", shares).collect()
    for row in got:
        scores = pdf[pdf.classifier == row["classifier"]].score
        assert np.isclose(row["score"], np.percentile(scores, shares[row["label"]] * 100), rtol=1e-9, atol=0), row
    assert len(got) == 5 * len(shares)
    assert quantiles(df.limit(0), "classifier", "score", shares).collect() == []


GOLDEN = [("a", 0.9), ("b", 0.5), ("c", 0.5), ("d", 0.1), ("e", 0.1), ("f", None), ("g", float("nan"))]


def golden(spark):
    rows = [(i, "web", True, "piqa", 1, "s", score) for i, score in GOLDEN]
    return spark.createDataFrame(
        rows,
        "id string, source string, contains_benchmark boolean, benchmark_type string, benchmark_index int, "
        "classifier string, score double",
    )


def test_both_rank_definitions(spark):
    shared = {r["id"]: (r["rank"], r["percentile"]) for r in ranking.shared_ranks(golden(spark)).collect()}
    assert shared == {
        "a": (1, 100), "b": (2, 75), "c": (2, 75), "d": (4, 25), "e": (4, 25), "f": (None, None), "g": (None, None)
    }
    report = ranking.needle_ranks(golden(spark)).orderBy("rank").collect()
    assert [(r["id"], r["rank"], r["percentile"]) for r in report] == [
        ("a", 1, 80), ("b", 2, 60), ("c", 3, 40), ("d", 4, 20), ("e", 5, 0)
    ]


def test_needle_ranks_are_those_of_the_full_ranking(spark, monkeypatch):
    df, _ = frame(spark)
    scores = df.withColumns({
        "source": F.lit("web"), "contains_benchmark": F.expr("hash(id) % 9 = 0"), "benchmark_type": F.lit("t"),
        "benchmark_index": F.lit(0),
    }).unionByName(golden(spark))
    key = F.when(F.expr("hash(id) % 5 > 0"), F.expr("hash(id, 1) % 3"))  # ties in score, in keys, and without keys
    scores = scores.withColumns({"rank_high": key.cast("long"), "rank_low": (key * key).cast("long")})
    scan, full = ranking.needle_ranks(scores), ranking.needles(ranking.ordinal_ranks(scores))
    columns = ["classifier", "id", "rank", "total", "score"]
    assert scan.count() == full.count() > 300
    assert scan.select(columns).exceptAll(full.select(columns)).isEmpty()
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    monkeypatch.setattr(ranking, "FEW", 10)
    many = ranking.needle_ranks(scores)
    assert many.count() == full.count() and many.select(columns).exceptAll(full.select(columns)).isEmpty()


def test_no_needles_give_no_rows(spark):
    scores = golden(spark).withColumn("contains_benchmark", F.lit(False))
    assert ranking.needle_ranks(scores).count() == 0


def test_no_window_over_the_whole_corpus(spark):
    df, _ = frame(spark)
    plan = number_rows(df, [], [F.desc("score"), "id"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan.split("Scan parquet")[0].split("BroadcastExchange")[0]
