import duckdb
import pytest

import __spark_entry__ as entry
from quality_probe.oracle.sql import STATEMENTS
from quality_probe.plans import experiment
from quality_probe.plans.queries import REGISTRY
from quality_probe.sources import items, web
from quality_probe.sources.stores import ScoreStore, TextStore

SMALL = "/root/testdata/sf0.001"
COUNTS = {n: {"count": 2, "subjects": items.SUBJECTS[:3]} for n in ("gsm8k", "piqa", "arc_easy")}


def test_every_query_has_a_statement():
    assert set(REGISTRY) == set(STATEMENTS)


@pytest.mark.parametrize(
    "name", ["scan_take_n", "bench_all_types", "inject_inside", "chunk_trim", "train_ngram_weights", "experiment_separate"]
)
def test_query_equals_statement(spark, name):
    db = duckdb.connect()
    for table in ("documents", "benchmark", "labels"):
        db.execute(f"CREATE VIEW {table} AS FROM read_parquet('{SMALL}/{table}.parquet')")
    df = entry.queries()[name](spark, SMALL)
    found = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(found.fetchall(), key=repr)
    got = sorted((tuple(r) for r in df.select(columns).collect()), key=repr)
    assert got == want and got


def test_separate_run_keeps_the_corpus_size(spark, raw, labels, item_table, tmp_path):
    config = experiment.job(benchmarks=COUNTS, dataset={"num_docs": 30}, cache={"top_n_documents": 2},
                            classifiers=[{"name": "binary_ngram", "enabled": True}, {"name": "top_label", "enabled": False}])
    store, texts = ScoreStore(spark, str(tmp_path / "s")), TextStore(spark, str(tmp_path / "t"))
    result = experiment.run(raw, labels, items.rows_by_type(item_table), config, store, texts)
    assert result.corpus.docs.count() == 30 and result.corpus.web_rows == 24
    assert result.ranks.count() == 6 and {r["total"] for r in result.ranks.select("total").collect()} == {27}  # three texts are blank
    assert texts.read("web").count() == 2
    again, dataset = experiment.reanalyze(store)
    columns = ["id", "classifier", "rank", "percentile", "score"]
    assert dataset == "web" and again.select(columns).exceptAll(result.ranks.select(columns)).isEmpty()


def test_injected_run_and_effect(raw, labels, item_table):
    config = experiment.job(benchmarks=COUNTS, experiment={"inject_inside": True, "seed": 7}, dataset={"num_docs": 20})
    result = experiment.run(raw, labels, items.rows_by_type(item_table), config)
    assert result.corpus.docs.count() == 20
    assert 1 <= result.corpus.docs.filter("contains_benchmark").count() <= 6
    effect = experiment.effect(result.corpus, result.ranks).collect()
    assert len(effect) == result.corpus.positions.count() == 6
    assert not any(r["is_standalone"] for r in effect)
    for r in effect:
        if r["original_score"] is not None:
            assert abs(r["benchmark_score"] - r["original_score"] - r["difference"]) < 1e-6


def test_prefiltered_run(raw, labels, item_table):
    config = experiment.job(benchmarks=COUNTS, dataset={"num_docs": 12, "prefilter_hq": True, "min_hq_score": 0.5},
                            classifiers=[{"name": "binary_ngram"}])
    result = experiment.run(raw, labels, items.rows_by_type(item_table), config)
    web = result.corpus.docs.filter("source = 'web'").orderBy("doc_pos").collect()
    assert [r["doc_pos"] for r in web] == list(range(6))
    assert all(r["original_score"] >= 0.5 for r in web) and result.corpus.docs.count() == 12
    standalone = experiment.effect(result.corpus, result.ranks).collect()
    assert all(r["is_standalone"] and r["difference"] is None for r in standalone) and len(standalone) == 6


@pytest.mark.parametrize("gaps", [False, True])
def test_documents_after_the_last_accepted_are_not_judged(spark, gaps, monkeypatch):
    monkeypatch.setattr(web, "FIRST_RANGE", 20)
    key = "id * 3 + 7" if gaps else "id"
    docs, rows = web.with_positions(spark.range(2000).selectExpr(f"{key} AS doc_id", "'text' AS text"))
    ranges = []

    def judge(part):
        low, high = part.selectExpr("min(doc_pos)", "max(doc_pos)").first()
        ranges.append((low, high))
        high_part = "CASE WHEN doc_pos % 10 = 9 AND doc_pos >= 100 THEN 9000000L ELSE -9000000L END AS full_quality_high"
        return part.selectExpr("doc_id", "doc_pos", "1D AS original_score", high_part, "0L AS full_quality_low")

    for wanted in (0, 30, 191):
        ranges.clear()
        found = web.first_accepted(docs, rows, judge, 0.5, wanted).orderBy("doc_pos").collect()
        whole = web.prefiltered(judge(docs), 0.5, wanted).orderBy("doc_pos").collect()
        assert found == whole and len(found) == min(wanted, 190)
        ranges.pop()
        assert [low for low, _ in ranges] == [0, *[high + 1 for _, high in ranges[:-1]]]  # each position once
        assert len(ranges) < 12
        if wanted == 30:
            assert found[-1]["source_pos"] == 399 and ranges[-1][1] < 900
    empty, none = web.with_positions(spark.range(0).selectExpr("id AS doc_id", "'' AS text"))
    assert web.first_accepted(empty, none, judge, 0.5, 5).count() == 0
