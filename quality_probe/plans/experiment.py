"""Whole jobs: run an experiment, or analyse a score store again."""

from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quality_probe.functions import heads
from quality_probe.operators import inject, ranking, reports
from quality_probe.operators.ngram import NgramModel, score_signals, train
from quality_probe.operators.ordering import without_slices
from quality_probe.operators.scoring import NATIVE, enabled, score_corpus
from quality_probe.operators.sizes import broadcast_if_small
from quality_probe.schemas import DOCUMENT_KEYS
from quality_probe.scratch import written
from quality_probe.sources import runs, sinks
from quality_probe.sources.benchmarks import sampled_items
from quality_probe.sources.runs import Runs
from quality_probe.sources.stores import ScoreStore, TextStore, default_dataset, score_with_store
from quality_probe.sources.web import (
    QUALITY,
    WEB,
    dataset_name,
    first_accepted,
    first_documents,
    prefiltered,
    prefiltered_documents,
    web_documents,
)

EFFECT_SCORER = "binary_ngram"  # whose scores tell the effect of an item

DEFAULTS = {
    "experiment": {"seed": 42, "inject_inside": False},
    "dataset": {"path": WEB, "part": None, "num_docs": None, "subset": None, "prefilter_hq": False, "min_hq_score": 0.7},
    "benchmarks": {},
    "classifiers": [{"name": name, "enabled": True} for name in NATIVE],
    "cache": {"top_n_documents": 100},
    "output": {"base_dir": None},
}


def job(**sections) -> dict:
    """A full configuration from the given parts."""
    return {
        name: {**default, **sections.get(name, {})} if isinstance(default, dict) else sections.get(name, default)
        for name, default in DEFAULTS.items()
    }


@dataclass(frozen=True)
class Corpus:
    """Documents with their benchmark text, the item positions and the untouched originals."""

    docs: DataFrame
    web_rows: int
    positions: DataFrame
    model: NgramModel
    injected: bool


def quality_scores(docs: DataFrame, model: NgramModel, carry: list) -> DataFrame:
    """`carry`, the quality probability as `original_score`, and the exact key of the ratio behind it."""
    return score_signals(docs, model, [QUALITY], carry, exact=True).select(
        *carry, F.expr(heads.probability(QUALITY)).alias("original_score"), f"{QUALITY}_high", f"{QUALITY}_low"
    )


def web_part(raw: DataFrame, whole: tuple, model: NgramModel, dataset: dict, budget: int) -> tuple:
    """Web documents and their number, prefiltered if the job says so. `whole` is the corpus as it is."""
    docs, rows = whole if dataset["subset"] is None else web_documents(raw, None, dataset["subset"])
    if not dataset["prefilter_hq"]:
        return first_documents(docs, rows, budget)
    kept = accepted_documents(docs, rows, model, dataset["min_hq_score"], budget)
    return prefiltered_documents(docs, kept), kept.count()


def accepted_documents(docs: DataFrame, rows: int, model: NgramModel, min_score: float, num_docs: int = None) -> DataFrame:
    """The first `num_docs` accepted of positioned documents (all, if None); later ones are not scored."""
    judge = partial(quality_scores, model=model, carry=["doc_id", "doc_pos"])
    if num_docs is None:
        return written(prefiltered(judge(docs), min_score), "accepted")
    return first_accepted(docs, rows, judge, min_score, num_docs)


def build_corpus(raw: DataFrame, labels: DataFrame, item_rows: dict, config: dict, model: NgramModel = None) -> Corpus:
    """Web documents plus items. `num_docs` is the size of the whole corpus; None takes every document."""
    settings, dataset = config["experiment"], config["dataset"]
    seed, inside, budget = settings["seed"], settings["inject_inside"], dataset["num_docs"]
    whole = web_documents(raw)
    if model is None:
        model = train(whole[0], labels)
    items = sampled_items(item_rows, config["benchmarks"], seed)
    if budget is not None and not inside:
        budget -= items.count()
    web, rows = web_part(raw, whole, model, dataset, budget)
    if not inside:
        docs = inject.inject_separate(web, items, rows)
        return Corpus(docs, rows, inject.positions_separate(items, rows), model, False)
    placed = inject.placed_items(items, rows, len(config["benchmarks"]), seed)
    docs = inject.inject_inside(web, placed)
    return Corpus(docs, rows, inject.positions_inside(placed, web), model, True)


def touched(corpus: Corpus, keep: list) -> DataFrame:
    """The documents of the position log, one row each."""
    ids = corpus.positions.select("doc_index").distinct()
    return corpus.docs.join(broadcast_if_small(ids.withColumnRenamed("doc_index", "doc_pos")), "doc_pos", "left_semi").select(
        "doc_pos", *keep
    )


def effect(corpus: Corpus, ranked: DataFrame, scorer: str = EFFECT_SCORER) -> DataFrame:
    """Score of each touched document with its items against its original text's."""
    found = written(touched(corpus, ["id", "source", F.col("original_text").alias("text")]), "touched")
    originals = quality_scores(found, corpus.model, ["id"]).withColumnRenamed("original_score", "score")
    own = ranked.filter(F.col("classifier") == scorer)
    return reports.injection_effect(corpus.positions, found.select("id", "source"), own, originals)


@dataclass(frozen=True)
class Result:
    corpus: Corpus
    scores: DataFrame
    ranks: DataFrame


def run(raw: DataFrame, labels: DataFrame, item_rows: dict, config: dict, store: ScoreStore = None,
        texts: TextStore = None, dataset: str = None) -> Result:
    """Build, score, rank and report.

    With a store, only unseen documents are scored; with an output folder, all reports are written and committed
    as one run. Stores and runs go by the dataset's name, which follows from its path and part unless one is given.
    """
    dataset = dataset or dataset_name(config["dataset"]["path"], config["dataset"]["part"])
    corpus = build_corpus(raw, labels, item_rows, config)
    scorers = enabled(config["classifiers"])
    if store is None:
        scores = written(score_corpus(corpus.docs, corpus.model, scorers), "scores")
    else:
        scores = written(score_with_store(corpus.docs, store, dataset, scorers, corpus.model), "scores")
    if texts is not None:
        texts.save_top(scores, corpus.docs, dataset, config["cache"]["top_n_documents"])
    result = Result(corpus, scores, ranking.needle_ranks(scores))
    base = config["output"]["base_dir"]
    if base is not None:
        write_reports(Runs(raw.sparkSession, base), result, config["dataset"]["prefilter_hq"], dataset)
    return result


def write_reports(folder: Runs, result: Result, prefiltered: bool, dataset: str) -> str:
    """Write and commit every report of a run; its id. The ranking is made once."""
    ranked = written(without_slices(ranking.ordinal_ranks(result.scores)), "ranked")
    found = ranking.needles(ranked).withColumn(
        "percentile", ranking.percentile_of(F.col("rank"), F.col("total"))
    )
    outputs = {
        runs.RANKS: lambda path: sinks.write_rank_report(reports.rank_report_json(found), path),
        runs.SCORES: lambda path: sinks.write_sorted_scores(ranked, path),
        runs.RANKINGS: lambda path: sinks.write_needle_rankings(found, path),
        runs.THRESHOLDS: lambda path: sinks.write_json(reports.score_thresholds(ranked), path),
        runs.STATS: lambda path: sinks.write_json(reports.score_stats(ranked), path),
    }
    if not result.scores.filter(F.col("classifier") == EFFECT_SCORER).isEmpty():
        outputs[runs.EFFECT] = lambda path: sinks.write_json(effect(result.corpus, found), path)
    return folder.write(outputs, result.corpus.injected, prefiltered, result.corpus.docs.count(), dataset)


def reanalyze(store: ScoreStore, dataset: str = None) -> tuple:
    """Needle ranks over everything stored for a dataset, and its name."""
    dataset = dataset or default_dataset(store)
    scores = store.read(dataset).select(*DOCUMENT_KEYS, "classifier", "score", *ranking.RANK_KEYS)
    return ranking.needle_ranks(scores), dataset


def comparison(scores: DataFrame, benchmarks: list, scorers: list) -> DataFrame:
    """The long frame behind a chart: needles with view ranks, filtered and in display order."""
    ranked = ranking.needles(ranking.shared_ranks(scores))
    kept = reports.filter_scorers(reports.filter_benchmarks(ranked, benchmarks), scorers)
    return kept.select(
        F.col("id").alias("benchmark_id"),
        "benchmark_type",
        "classifier",
        "rank",
        "percentile",
        "score",
    ).orderBy(
        reports.preset_position("classifier", reports.PRESET_SCORERS),
        "classifier",
        reports.preset_position("benchmark_type", reports.BENCHMARK_ORDER),
        "benchmark_type",
        "benchmark_id",
    )
