from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quality_probe.operators import scoring
from quality_probe.plans import experiment
from quality_probe.sources import commits, items, runs, sinks
from quality_probe.sources.runs import Runs
from quality_probe.sources.stores import ScoreStore

COUNTS = {n: {"count": 2, "subjects": items.SUBJECTS[:3]} for n in ("gsm8k", "piqa")}
TAGS = {"injected": False, "prefiltered": False, "num_docs": 7, "dataset": "web"}


def test_a_job_writes_every_report(spark, raw, labels, item_table, tmp_path):
    base = str(tmp_path / "results")
    config = experiment.job(
        benchmarks=COUNTS, output={"base_dir": base}, experiment={"inject_inside": True},
        dataset={"path": "org/corpus", "part": "fra"}, classifiers=[{"name": "binary_ngram"}, {"name": "top_label"}],
    )
    store = ScoreStore(spark, str(tmp_path / "scores"))
    result = experiment.run(raw, labels, items.rows_by_type(item_table), config, store)
    (run,) = Runs(spark, base).listed()
    assert (run["mode"], run["num_docs"], run["dataset"]) == ("injected", 40, "corpus-fra")
    assert run["suffix"] == "_injected_40docs" and set(run["outputs"]) == {
        runs.RANKS, runs.SCORES, runs.RANKINGS, runs.THRESHOLDS, runs.STATS, runs.EFFECT
    }
    assert [r[0] for r in store.datasets().collect()] == ["corpus-fra"]
    read = {name: Runs(spark, base).read(name) for name in run["outputs"]}
    assert read[runs.RANKINGS].count() == result.ranks.count() > 0
    assert read[runs.SCORES].count() == result.scores.filter("score IS NOT NULL").count()
    assert read[runs.THRESHOLDS].count() == 22 and read[runs.STATS].count() == 2
    assert read[runs.EFFECT].count() == experiment.effect(result.corpus, result.ranks).count() > 0
    assert all({"run_id", "mode", "prefiltered", "num_docs", "dataset"} <= set(df.columns) for df in read.values())


def test_a_killed_run_leaves_nothing_and_is_retried(spark, tmp_path):
    folder = Runs(spark, str(tmp_path))
    good, bad = spark.range(3), spark.range(3).select(F.raise_error(F.lit("killed")).alias("id"))
    outputs = {"first": lambda path: sinks.write_json(good, path), "second": lambda path: sinks.write_json(bad, path)}
    with pytest.raises(Exception, match="killed"):
        folder.write(outputs, **TAGS)
    assert folder.listed() == []
    with pytest.raises(LookupError):
        folder.read("first")
    outputs["second"] = outputs["first"]
    run_id = folder.write(outputs, **TAGS, now=datetime(2024, 5, 6, 7, 8, 9))
    assert run_id.startswith("20240506_070809-") and folder.read("second").count() == 3
    assert folder.read("first", run_id).select("run_id", "mode", "num_docs").distinct().collect() == [(run_id, "separate", 7)]


def test_runs_at_one_time_are_all_kept(spark, tmp_path, monkeypatch):
    first, second = Runs(spark, str(tmp_path)), Runs(spark, str(tmp_path))
    one = {"rows": lambda path: sinks.write_json(spark.range(2), path)}

    def meanwhile(path):
        one["rows"](path)
        second.write(one, **TAGS)

    stale = first.commits.state()
    first.write({"rows": meanwhile}, **TAGS)
    assert len(first.listed()) == 2
    with pytest.raises(commits.Conflict):
        first.commits.commit(stale[0], [])


def test_options_of_a_job_reach_its_scorers():
    scoring.register_scorer(scoring.ExternalScorer("lengths", lambda: None, lambda model, texts: [1] * len(texts)))
    try:
        config = [{"name": "lengths", "enabled": True, "batch_size": 32}, {"name": "top_label", "enabled": False}]
        (scorer,) = scoring.enabled(config)
        assert (scorer.name, scorer.batch_size) == ("lengths", 32)
        assert scoring.SCORERS["lengths"].batch_size == 100
    finally:
        del scoring.SCORERS["lengths"]
