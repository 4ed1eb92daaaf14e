"""Registered queries: each runs one operator or job over the whole test tables."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quality_probe.functions import heads
from quality_probe.functions import text as T
from quality_probe.operators import inject, ranking, reports
from quality_probe.operators.ngram import score_signals, train
from quality_probe.operators.ordering import without_slices
from quality_probe.operators.scoring import NATIVE, ExternalScorer, score_corpus, score_external
from quality_probe.plans import experiment
from quality_probe.schemas import DOCUMENT_KEYS, SCORE, names
from quality_probe.scratch import fresh_path, written
from quality_probe.sources import benchmarks, items, stores, web
from quality_probe.sources.runs import RANKS, Runs
from quality_probe.sources.stores import (
    SKIPPED_DATASET,
    ScoreStore,
    TextStore,
    hashed,
    hit_counts,
    hits,
    misses,
    parsed_map,
    score_unseen,
)
from quality_probe.streaming import jobs

SEED = 42
PARTITIONS = "quality_probe.partitions"  # setting: deal texts out to so many partitions; unset, they stay as scanned
MIN_SCORE = 0.7
TOP_VIEW, TOP_STORED = 10, 100
SAMPLE = 10
PER_SUBJECT = 3
JSON_BLOCK = 1000
ONE = ["binary_ngram"]

ALL_ITEMS = {
    name: {"count": None, "subjects": items.SUBJECTS if name == "mmlu" else None} for name in items.TYPES
}
SEPARATE = experiment.job(benchmarks=ALL_ITEMS)
INJECTED = experiment.job(benchmarks=ALL_ITEMS, experiment={"inject_inside": True})


TABLES = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
}


class Tables:
    """The given tables and what several queries derive from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.raw, self.benchmark, self.labels = (self.table(n) for n in TABLES)
        partitions = spark.conf.get(PARTITIONS, None)
        if partitions:
            self.raw = self.raw.repartition(int(partitions), "doc_id")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.folder}/{name}.parquet")

    def path(self, name: str) -> str:
        return fresh_path(self.spark, name)

    def web(self) -> DataFrame:
        return web.web_documents(self.raw)[0]

    def labelled(self) -> DataFrame:
        return self.web().join(self.labels.select("doc_id"), "doc_id", "left_semi")

    def model(self):
        return train(self.web(), self.labels)

    def items(self) -> DataFrame:
        return benchmarks.sampled_items(items.rows_by_type(self.benchmark), ALL_ITEMS, SEED)

    def unscored(self) -> tuple:
        """The corpus with items apart, and with items inside."""
        docs, rows = web.web_documents(self.raw)
        found = self.items()
        inside = inject.inject_inside(docs, inject.placed_items(found, rows, len(ALL_ITEMS), SEED))
        return inject.inject_separate(docs, found, rows), inside

    def corpus(self, config=SEPARATE) -> experiment.Corpus:
        return experiment.build_corpus(self.raw, self.labels, items.rows_by_type(self.benchmark), config)

    def scores(self, scorers=None, config=SEPARATE) -> DataFrame:
        corpus = self.corpus(config)
        return written(score_corpus(corpus.docs, corpus.model, scorers), "scores")

    def run(self, config) -> experiment.Result:
        return experiment.run(self.raw, self.labels, items.rows_by_type(self.benchmark), config)

    def store(self) -> ScoreStore:
        return ScoreStore(self.spark, self.path("score-store"))


REGISTRY: dict = {}


def query(build):
    """Register `build(tables)` under its own name."""

    def call(spark: SparkSession, folder: str) -> DataFrame:
        return build(Tables(spark, folder))

    REGISTRY[build.__name__] = call
    return build


# --- sources -------------------------------------------------------------------------------------


@query
def scan_take_n(t):
    docs, _ = web.web_documents(t.raw, t.raw.count() // 2)
    return docs.select("doc_pos", "id", "source", "text", "contains_benchmark", "benchmark_type", "original_text")


def prefilter_parts(t):
    docs, rows = web.web_documents(t.raw)
    model = train(docs, t.labels)
    return docs, rows, experiment.accepted_documents(docs, rows, model, MIN_SCORE, rows // 4)


@query
def prefilter_hq(t):
    docs, _, kept = prefilter_parts(t)
    found = web.prefiltered_documents(docs, kept)
    return found.select("id", "doc_pos", "doc_id", "original_score", "text")


@query
def prefilter_acceptance(t):
    _, rows, kept = prefilter_parts(t)
    return web.acceptance(rows, kept, rows // 4)


@query
def bench_first_k_per_subject(t):
    rows = items.rows_as(t.benchmark, "mmlu")
    return benchmarks.load_samples(rows, "mmlu", PER_SUBJECT, items.SUBJECTS).select("subject", "item_id")


def samples(frames: dict, names: list) -> DataFrame:
    drawn = [
        benchmarks.load_samples(frames[n], n, SAMPLE, seed=SEED).select(F.lit(n).alias("benchmark_type"), "item_id")
        for n in names
    ]
    return reduce(DataFrame.unionByName, drawn)


@query
def bench_sample_strict(t):
    names = ["gsm8k", "gpqa"]
    return samples({n: items.rows_as(t.benchmark, n) for n in names}, names)


@query
def bench_sample_capped(t):
    return samples(items.rows_by_type(t.benchmark), ["arc_challenge", "arc_easy", "hellaswag", "piqa", "truthfulqa"])


@query
def bench_all_types(t):
    return t.items().select("item_pos", "benchmark_type", "subject", "text")


@query
def bench_index(t):
    return t.items().select("benchmark_type", "benchmark_index", "subject", "text")


def filled_store(t) -> ScoreStore:
    """The whole corpus stored as dataset "web", the labelled documents also as "old"."""
    corpus, store = t.corpus(), t.store()
    score_unseen(corpus.docs, store, "web", NATIVE, corpus.model)
    score_unseen(t.labelled(), store, SKIPPED_DATASET, ONE, corpus.model)
    return store


@query
def score_store_read(t):
    return filled_store(t).read("web", NATIVE).select("dataset", "classifier", "doc_hash", "id", "score")


def score_maps(t) -> DataFrame:
    """JSON objects from hash to score record, of a thousand documents each."""
    corpus = t.corpus()
    scores = score_corpus(hashed(corpus.docs), corpus.model, ["dual_head"], [*DOCUMENT_KEYS, "doc_hash", "doc_pos"])
    record = F.struct(*[c for c in names(SCORE) if c != "classifier"])
    return scores.groupBy(F.floor(F.col("doc_pos") / JSON_BLOCK).alias("block")).agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("doc_hash", record)))).alias("json")
    )


@query
def json_map_explode(t):
    parsed = score_maps(t).select(F.explode(parsed_map("json")).alias("doc_hash", "r"))
    return parsed.select("doc_hash", "r.id", "r.source", "r.contains_benchmark", "r.benchmark_type",
                         "r.benchmark_index", "r.score", "r.int_score", "r.binary_pred", "r.prob")


@query
def score_json_import(t):
    """Files that hold one compact object each, read back by many tasks."""
    path = t.path("score-json")
    score_maps(t).repartition("block").write.partitionBy("block").text(path)
    return stores.read_score_json(t.spark, path, "dual_head", "web").select(
        "classifier", "dataset", "doc_hash", "id", "source", "score", "int_score", "binary_pred", "prob"
    )


@query
def text_json_import(t):
    path = t.path("text-json")
    texts = t.web().groupBy(F.floor(F.col("doc_pos") / JSON_BLOCK).alias("block")).agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("id", F.coalesce("text", F.lit("")))))).alias("json")
    )
    texts.repartition("block").write.partitionBy("block").text(path)
    return stores.read_text_json(t.spark, path, "web")


@query
def list_datasets(t):
    store, model = t.store(), t.model()
    languages = t.raw.select("doc_id", "lang")
    scores = score_corpus(hashed(t.web()), model, ONE, [*DOCUMENT_KEYS, "doc_hash", "doc_id"]).join(languages, "doc_id")
    store.append(scores, F.when(F.col("lang") == "es", SKIPPED_DATASET).otherwise(F.concat(F.lit("web-"), F.col("lang"))))
    return store.datasets().filter(F.col("dataset") != SKIPPED_DATASET)


# --- templates and text --------------------------------------------------------------------------


def template_query(key: str, name: str):
    def build(t):
        return items.rows_as(t.benchmark, name).select("item_id", benchmarks.benchmark(name).text().alias("text"))

    build.__name__ = key
    return query(build)


for _name in items.TYPES:
    template_query({"arc_challenge": "tmpl_arc"}.get(_name, f"tmpl_{_name}"), _name)


@query
def normalize_newlines(t):
    return t.raw.select("doc_id", T.normalize_newlines("text").alias("text"))


@query
def collapse_newlines(t):
    return t.raw.select("doc_id", T.collapse_newlines("text").alias("text"))


@query
def label_strip(t):
    return t.raw.select(
        "doc_id",
        T.strip_label(F.concat(F.lit(T.LABEL_PREFIX), "lang")).alias("lang_label"),
        T.strip_label(F.concat(F.lit(T.LABEL_PREFIX), "source")).alias("source_label"),
        T.strip_label(F.concat(F.lit(T.LABEL_PREFIX), "text")).alias("text_label"),
    )


@query
def doc_hash(t):
    return hashed(t.web()).select("id", "doc_hash")


@query
def truncate_words(t):
    return t.raw.select("doc_id", F.array_join(T.first_words("text"), " ").alias("text"))


@query
def chunk_head_tail(t):
    return t.raw.select("doc_id", F.posexplode(T.raw_chunks(F.col("text"))).alias("chunk_no", "chunk"))


@query
def chunk_trim(t):
    return t.raw.select("doc_id", F.posexplode(T.chunks(F.col("text"))).alias("chunk_no", "chunk"))


def raw_scores(t) -> DataFrame:
    """Score texts as a loose store may hold them: numbers, names, "NaN" and nothing."""
    kind = F.col("n_chars") % 4
    value = (
        F.when(kind == 0, F.col("source"))
        .when(kind == 1, F.lit("NaN"))
        .when(kind == 2, F.lit(None))
        .otherwise(F.concat(F.col("n_chars").cast("string"), F.lit(".25")))
    )
    return t.raw.select("doc_id", value.alias("raw"))


@query
def score_coerce(t):
    return raw_scores(t).select("doc_id", ranking.coerced("raw").alias("score"))


@query
def drop_unscored(t):
    return ranking.scored(raw_scores(t).select("doc_id", F.col("raw").try_cast("double").alias("score")))


# --- injection -----------------------------------------------------------------------------------


def placed(t) -> tuple:
    docs, rows = web.web_documents(t.raw)
    return docs, inject.placed_items(t.items(), rows, len(ALL_ITEMS), SEED)


@query
def inject_ranges(t):
    return placed(t)[1].select("benchmark_type", "range_start", "range_end").distinct()


@query
def inject_positions(t):
    return placed(t)[1].select("benchmark_type", "benchmark_index", "doc_pos")


@query
def inject_inside(t):
    return inject.inject_inside(*placed(t)).select(
        "doc_pos", "id", "text", "contains_benchmark", "benchmark_type", "benchmark_index", "benchmark_subject"
    )


@query
def inject_separate(t):
    docs, rows = web.web_documents(t.raw)
    return inject.inject_separate(docs, t.items(), rows).select(
        "doc_pos", "id", "source", "text", "contains_benchmark", "benchmark_type", "benchmark_index", "benchmark_subject"
    )


@query
def position_log(t):
    docs, rows = web.web_documents(t.raw)
    found = t.items()
    inside = inject.positions_inside(inject.placed_items(found, rows, len(ALL_ITEMS), SEED), docs)
    separate = inject.positions_separate(found, rows)
    return inside.withColumn("mode", F.lit("injected")).unionByName(separate.withColumn("mode", F.lit("separate")))


@query
def infer_mode(t):
    def inferred(name, docs):
        return reports.inferred_mode(docs).select(F.lit(name).alias("corpus"), "mode")

    apart, inside = t.unscored()
    return inferred("items apart", apart).unionByName(inferred("items inside", inside))


# --- scoring -------------------------------------------------------------------------------------


@query
def train_ngram_weights(t):
    return t.model().weights()


@query
def score_ngram_hq(t):
    corpus = t.corpus()
    return score_signals(corpus.docs, corpus.model, ["full_quality"]).select(
        "id", F.col("full_quality").alias("micro_logit"), F.expr(heads.probability("full_quality")).alias("score")
    )


@query
def score_top_label(t):
    corpus = t.corpus()
    made = {**heads.top_label("full_quality"), "p_hq": heads.probability("full_quality")}
    return score_signals(corpus.docs, corpus.model, ["full_quality"]).selectExpr(
        "id", *[f"{made[name]} AS {name}" for name in ("score", "label", "p_hq")]
    )


def scorer_query(key: str, scorers: list, columns: list):
    def build(t):
        corpus = t.corpus()
        return score_corpus(corpus.docs, corpus.model, scorers).select("id", *columns)

    build.__name__ = key
    return query(build)


scorer_query("head_edu_regression", ["edu_regression"], ["score", "int_score"])
scorer_query("head_three_class", ["three_class"], ["score", "int_score"])
scorer_query("head_edu_binary", ["edu_binary"], ["score", "int_score", "label"])
scorer_query("head_dual", ["dual_head"], ["score", "int_score", "binary_pred", "prob"])
scorer_query("score_chunk_max", ["chunk_edu", "chunk_edu_v2", "chunk_binary"], ["classifier", "score", "int_score"])
scorer_query("score_all", NATIVE, ["classifier", "score", "int_score", "label", "binary_pred", "prob"])


def vowel_share(model, texts: list) -> list:
    """Stand-in for a downloaded model."""
    return [sum(map(text.count, model)) / len(text) for text in texts]


@query
def score_external_stub(t):
    scorer = ExternalScorer("vowel_share", lambda: "aeiou", vowel_share, batch_size=32)
    return score_external(t.unscored()[0], scorer).select("id", "score")


@query
def scores_union(t):
    scores = t.scores(["binary_ngram", "edu_binary", "dual_head"])
    columns = {"binary_ngram": [], "edu_binary": ["int_score", "label"], "dual_head": ["int_score", "binary_pred", "prob"]}
    frames = [
        scores.filter(F.col("classifier") == n).select("classifier", "id", "score", *c) for n, c in columns.items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


# --- store ---------------------------------------------------------------------------------------


def half_filled(t) -> tuple:
    """A store that knows the labelled documents, all documents with hashes, and the model."""
    store, model = t.store(), t.model()
    score_unseen(t.labelled(), store, "web", NATIVE, model)
    return store, hashed(t.web()), model


@query
def cache_hits(t):
    store, docs, _ = half_filled(t)
    return hits(docs.select("doc_hash", "id"), store.read("web", ONE))


@query
def cache_misses(t):
    store, docs, _ = half_filled(t)
    return misses(docs.select("doc_hash", "id"), store.read("web", ONE))


@query
def cache_stats(t):
    store, docs, _ = half_filled(t)
    return hit_counts(docs, store.read("web", ONE))


@query
def score_with_store(t):
    store, _, model = half_filled(t)
    return stores.score_with_store(t.web(), store, "web", NATIVE, model).select("doc_hash", "id", "classifier", "score")


@query
def top_text_merge(t):
    corpus = t.corpus()
    scores = written(score_corpus(corpus.docs, corpus.model), "scores")
    texts = TextStore(t.spark, t.path("texts"))
    earlier = F.concat(F.lit("stored earlier: "), F.col("id"))
    texts.append(t.labelled().select("id", earlier.alias("text")), "web")
    return texts.save_top(scores, corpus.docs, "web", TOP_STORED)


def with_stored_texts(t) -> tuple:
    """All scores, and the texts that a job stores: those of the best documents of each scorer."""
    corpus = t.corpus()
    scores = written(score_corpus(corpus.docs, corpus.model), "scores")
    return scores, TextStore(t.spark, t.path("texts")).save_top(scores, corpus.docs, "web", TOP_STORED)


@query
def top_docs_text(t):
    scores, texts = with_stored_texts(t)
    top = reports.top_documents(scores, TOP_VIEW)
    return top.join(texts, "id", "left").select(
        "classifier", "top_rank", "id", F.coalesce("text", F.lit(reports.TEXT_MISSING)).alias("text")
    )


@query
def top_doc_cards(t):
    return reports.top_document_cards(*with_stored_texts(t), TOP_VIEW)


# --- ranks ---------------------------------------------------------------------------------------


@query
def rank_ordinal(t):
    return without_slices(ranking.ordinal_ranks(t.scores())).select("classifier", "id", "score", "rank", "total")


def with_percentile(ranked: DataFrame) -> DataFrame:
    return ranked.withColumn("percentile", ranking.percentile_of(F.col("rank"), F.col("total"))).select(
        "classifier", "id", "rank", "total", "percentile", "score"
    )


@query
def needle_percentile(t):
    return with_percentile(ranking.needles(ranking.ordinal_ranks(t.scores())))


@query
def needle_rank_scan(t):
    return ranking.needle_ranks(t.scores()).select("classifier", "id", "rank", "total", "percentile", "score")


@query
def rank_min(t):
    return ranking.shared_ranks(t.scores()).select("classifier", "id", "score", "rank")


@query
def percentile_minrank(t):
    return ranking.shared_ranks(t.scores()).select("classifier", "id", "rank", "percentile")


@query
def top_k_per_classifier(t):
    return reports.top_documents(t.scores(), TOP_VIEW).select("classifier", "top_rank", "id", "score")


@query
def top_ids_union(t):
    return reports.top_ids(t.scores(), TOP_VIEW)


# --- reports -------------------------------------------------------------------------------------


@query
def needle_summary(t):
    summary = reports.needle_summary(ranking.shared_ranks(t.scores()))
    means = ["rank_mean", "percentile_mean", "score_mean", "percentile_median", "score_median"]
    return summary.select(*[F.round(c, 9).alias(c) if c in means else F.col(c) for c in summary.columns])


@query
def needle_summary_rounded(t):
    return reports.rounded_summary(reports.needle_summary(ranking.shared_ranks(t.scores())))


@query
def score_thresholds(t):
    return reports.score_thresholds(t.scores())


@query
def score_stats(t):
    return reports.score_stats(t.scores())


@query
def score_range(t):
    return reports.score_range(t.scores())


@query
def corpus_counts(t):
    return reports.corpus_counts(t.scores())


@query
def facets(t):
    return reports.facets(t.scores())


@query
def preset_order(t):
    place = F.when(
        F.col("facet") == "classifier", reports.preset_position("value", reports.PRESET_SCORERS)
    ).otherwise(reports.preset_position("value", reports.BENCHMARK_ORDER))
    order = Window.partitionBy("facet").orderBy(place, "value")
    return reports.facets(t.scores()).select("facet", "value", F.row_number().over(order).alias("place"))


@query
def filter_benchmarks(t):
    kept = reports.filter_benchmarks(ranking.needles(t.scores()), [reports.PRESET, "piqa"])
    return kept.select("classifier", "id", "benchmark_type", "score")


@query
def filter_classifiers(t):
    return reports.filter_scorers(t.scores(), [reports.PRESET, "chunk_edu"]).select("classifier", "id", "score")


@query
def rank_report_wide(t):
    return reports.rank_report_wide(ranking.needle_ranks(t.scores()), NATIVE)


@query
def rank_report_json(t):
    report = reports.rank_report_json(ranking.needle_ranks(t.scores()))
    result = "struct<rank:bigint,percentile:double,score:double>"
    fields = ", ".join(["id string", "benchmark_type string", "benchmark_index int", *[f"{s} {result}" for s in NATIVE]])
    parsed = report.select(F.from_json("report", fields).alias("r")).select("r.*")
    per_scorer = F.array(*[F.struct(F.lit(s).alias("classifier"), F.col(s).alias("result")) for s in NATIVE])
    return parsed.select("id", "benchmark_type", "benchmark_index", F.inline(per_scorer)).select(
        "id", "benchmark_type", "benchmark_index", "classifier", "result.rank", "result.percentile", "result.score"
    ).dropna(subset=["rank"])


def effect_of(t, name: str, config: dict) -> DataFrame:
    result = t.run({**config, "classifiers": [{"name": n} for n in ONE]})
    return experiment.effect(result.corpus, result.ranks).withColumn("mode", F.lit(name))


@query
def injection_effect(t):
    return effect_of(t, "injected", INJECTED).unionByName(effect_of(t, "separate", SEPARATE))


# --- whole jobs ----------------------------------------------------------------------------------

RANK_COLUMNS = ["id", "benchmark_type", "benchmark_index", "classifier", "rank", "total", "percentile", "score"]


@query
def experiment_separate(t):
    return t.run(SEPARATE).ranks.select(*RANK_COLUMNS)


@query
def run_reports(t):
    """A whole job with its reports committed, and the rank report read back from the run."""
    base = t.path("results")
    t.run({**SEPARATE, "output": {"base_dir": base}})
    report = Runs(t.spark, base).read(RANKS)
    per_scorer = F.array(*[F.struct(F.lit(s).alias("classifier"), F.col(s).alias("result")) for s in NATIVE])
    return report.select("mode", "prefiltered", "num_docs", "dataset", "id", "benchmark_type", F.inline(per_scorer)).select(
        "mode", "prefiltered", "num_docs", "dataset", "id", "benchmark_type", "classifier", "result.rank",
        "result.percentile", "result.score",
    ).dropna(subset=["rank"])


@query
def experiment_injected(t):
    result = t.run(INJECTED)
    effect = experiment.effect(result.corpus, result.ranks).drop("is_standalone")
    ranks = result.ranks.select(F.col("id").alias("doc_id"), "classifier", "rank", "percentile", "score")
    return effect.join(ranks, "doc_id")


@query
def reanalyze_store(t):
    store = filled_store(t)
    ranks, dataset = experiment.reanalyze(store)
    mode = reports.inferred_mode(store.read(dataset)).first()["mode"]
    return ranks.select(F.lit(dataset).alias("dataset"), F.lit(mode).alias("mode"), *RANK_COLUMNS)


@query
def comparison_long(t):
    return experiment.comparison(t.scores(), [reports.PRESET, "piqa"], [reports.ALL])


# --- streaming -----------------------------------------------------------------------------------


def document_stream(t):
    """The given table as a stream, be it a file or a folder of files: of a path with a glob Spark takes either."""
    return jobs.document_stream(t.spark, f"{t.folder}/documents.parque[t]", t.raw.schema, "*")


@query
def stream_prefilter(t):
    sink = t.path("accepted")
    jobs.prefilter_stream(document_stream(t), t.model(), sink, t.path("stream"), MIN_SCORE)
    return t.spark.read.parquet(sink).select("doc_id", "original_score", "text")


@query
def stream_prefilter_first(t):
    sink, wanted = t.path("accepted"), t.raw.count() // 4
    jobs.prefilter_stream(document_stream(t), t.model(), sink, t.path("stream"), MIN_SCORE, num_docs=wanted)
    return t.spark.read.parquet(sink).select("doc_id", "original_score", "text")


@query
def stream_score_store(t):
    store, model = t.store(), t.model()
    for _ in range(2):  # the second run meets every document again and adds nothing
        jobs.score_stream(document_stream(t), model, store, "web", NATIVE, t.path("stream"))
    return store.read("web", NATIVE).select("doc_hash", "id", "classifier", "score")
