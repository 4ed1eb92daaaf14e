"""The score store and the text store: keyed tables that grow by committed parts of unseen rows only."""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quality_probe.functions.text import doc_hash
from quality_probe.operators import bloom
from quality_probe.operators.ngram import NgramModel
from quality_probe.operators.reports import merged_texts, top_texts
from quality_probe.operators.scoring import Scorer, chosen, score_external, score_native
from quality_probe.operators.sizes import is_small
from quality_probe.schemas import DOCUMENT_KEYS, SCORE, STORE, TEXTS, names
from quality_probe.scratch import written
from quality_probe.sources import json_maps
from quality_probe.sources.commits import CommittedTable, Conflict

SKIPPED_DATASET = "old"

PREFIX = "hash_prefix"
PREFIX_DIGITS = 2  # of a document's hash: 256 folders a scorer once rows are merged
UNSORTED = "any"  # folder of rows that are not merged yet
FAN = 8  # parts of a level that are merged into one of the next
ATTEMPTS = 5  # of a commit, if others commit in between


def read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class ScoreStore:
    """Scores by content hash, in folders per dataset, scorer and hash prefix.

    New rows come as small parts; FAN parts of a level are merged into one of the next level, so there are few parts
    at any size and a row is rewritten a logarithmic number of times. Merged rows lie in folders by hash prefix, and
    a lookup reads the prefixes of its documents only.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        schema = StructType([*STORE.fields, StructField(PREFIX, StringType())])
        self.table = CommittedTable(spark, path, schema, ["dataset", "classifier", PREFIX])

    def read(self, dataset: str = None, scorers: list = None, prefixes: list = None, parts: list = None) -> DataFrame:
        """Stored records; all filters select folders."""
        rows = self.table.rows(parts)
        if dataset is not None:
            rows = rows.filter(F.col("dataset") == dataset)
        if scorers is not None:
            rows = rows.filter(F.col("classifier").isin(scorers))
        if prefixes is not None:
            rows = rows.filter(F.col(PREFIX).isin([*prefixes, UNSORTED]))
        return rows.select(names(STORE))

    def append(self, scores: DataFrame, dataset, state: tuple = None) -> None:
        """Commit records with `doc_hash`; `dataset` is a name or a Column.

        With the `state` that the records were chosen by, another commit since then raises a Conflict.
        """
        column = F.lit(dataset) if isinstance(dataset, str) else dataset
        rows = scores.withColumn("dataset", column).select(names(STORE)).withColumn(PREFIX, F.lit(UNSORTED))
        part = {"name": self.table.stage(rows), "level": 0}
        if state is not None:
            self.table.commit(state[0], [*state[1], part])
        else:
            self._committed(lambda parts: [*parts, part])
        self.merge()

    def _committed(self, change) -> None:
        for _ in range(ATTEMPTS):
            number, parts = self.table.state()
            try:
                return self.table.commit(number, change(parts))
            except Conflict:
                continue
        raise Conflict(f"{self.path}: no commit in {ATTEMPTS} attempts")

    def merge(self, fan: int = FAN) -> None:
        """Merge the parts of each level that has `fan` of them."""
        while True:
            _, parts = self.table.state()
            levels = {}
            for part in parts:
                levels.setdefault(part["level"], []).append(part)
            full = [level for level, found in levels.items() if len(found) >= fan]
            if not full:
                return
            merged = levels[min(full)]
            rows = self.table.rows(merged).dropDuplicates(["dataset", "classifier", "doc_hash"])
            prefix = F.left("doc_hash", F.lit(PREFIX_DIGITS))
            new = {"name": self.table.stage(rows.withColumn(PREFIX, prefix)), "level": min(full) + 1}
            gone = {part["name"] for part in merged}
            try:
                self._committed(lambda parts, gone=gone, new=new: replaced_parts(parts, gone, new))
            except LookupError:  # another writer has merged them
                return

    def datasets(self) -> DataFrame:
        return self.read().select("dataset").distinct()


def replaced_parts(parts: list, gone: set, new: dict) -> list:
    if not gone <= {part["name"] for part in parts}:
        raise LookupError("parts to be merged are no longer in use")
    return [*[part for part in parts if part["name"] not in gone], new]


def default_dataset(store: ScoreStore):
    """First dataset by name, but never the folder of old results."""
    row = store.datasets().filter(F.col("dataset") != SKIPPED_DATASET).agg(F.min("dataset")).first()
    if row[0] is None:
        raise ValueError(f"no datasets found in {store.path}")
    return row[0]


def hashed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("doc_hash", doc_hash(F.col("id"), F.col("text")))


def hits(docs: DataFrame, stored: DataFrame) -> DataFrame:
    return docs.join(stored.select("doc_hash"), "doc_hash", "left_semi")


def misses(docs: DataFrame, stored: DataFrame) -> DataFrame:
    return docs.join(stored.select("doc_hash"), "doc_hash", "left_anti")


def hit_counts(docs: DataFrame, stored: DataFrame) -> DataFrame:
    """Hits and misses of the documents against the store."""
    known = stored.select("doc_hash").distinct().withColumn("_known", F.lit(True))
    return docs.select("doc_hash").join(known, "doc_hash", "left").agg(
        F.count("_known").alias("cache_hits"), F.count_if(F.col("_known").isNull()).alias("cache_misses")
    )


def listed_keys(docs: DataFrame) -> DataFrame:
    """doc_pos, doc_hash and metadata of each document, from one pass over the texts."""
    return written(hashed(docs).select("doc_pos", "doc_hash", *DOCUMENT_KEYS), "document-keys")


def prefixes_of(keys: DataFrame) -> list:
    """The hash prefixes of the documents, 256 at most."""
    return [r[0] for r in keys.select(F.left("doc_hash", F.lit(PREFIX_DIGITS))).distinct().collect()]


def lacking(keys: DataFrame, stored: DataFrame, scorers: list) -> DataFrame:
    """doc_hash, doc_pos, missing: one document for each hash that lacks scorers, whose bits are set in `missing`.

    Only the stored rows of these documents are grouped.
    """
    wanted = keys.groupBy("doc_hash").agg(F.min("doc_pos").alias("doc_pos"))
    hashes = wanted.select("doc_hash")
    if is_small(hashes, "doc_hash"):
        hashes = F.broadcast(hashes)
    bit = F.element_at(F.create_map(*[F.lit(v) for i, s in enumerate(scorers) for v in (s, 1 << i)]), F.col("classifier"))
    known = stored.join(hashes, "doc_hash", "left_semi").groupBy("doc_hash").agg(F.bit_or(bit).alias("known"))
    everything = F.lit((1 << len(scorers)) - 1)
    missing = everything.bitwiseAND(F.bitwise_not(F.coalesce("known", F.lit(0))))
    return written(
        wanted.join(known, "doc_hash", "left").select("doc_hash", "doc_pos", missing.alias("missing")).filter("missing > 0"),
        "lacking",
    )


def fresh_scores(docs: DataFrame, wanted: DataFrame, listed: list, model: NgramModel) -> DataFrame:
    """Records of the missing scorers alone, with `doc_hash`; failed texts give none.

    The native scorers share one pass over the documents that lack any of them, an external one meets only those
    that lack it. No text is moved: few documents are picked by a broadcast, many by a Bloom filter, and the narrow
    results are then matched exactly.
    """
    bits = {scorer.name: 1 << i for i, scorer in enumerate(listed)}
    native = [s for s in listed if isinstance(s, Scorer)]
    groups = [native] if native else []
    groups += [[s] for s in listed if not isinstance(s, Scorer)]
    found = []
    for group in groups:
        mask = sum(bits[s.name] for s in group)
        some = wanted.filter(F.col("missing").bitwiseAND(F.lit(mask)) > 0)
        needed = {r["missing"] for r in some.select("missing").distinct().collect()}  # as many as sets of scorers
        group = [s for s in group if any(bits[s.name] & m for m in needed)]
        if not group:
            continue
        picked = matching(docs, some.select("doc_pos"))
        carry = ["doc_pos", *DOCUMENT_KEYS]
        if group[0] in native:
            scores = score_native(picked, model, group, carry)
        else:
            scores = score_external(picked, group[0], carry).filter("error IS NULL").drop("error")
        bit = F.element_at(F.create_map(*[F.lit(v) for s in group for v in (s.name, bits[s.name])]), F.col("classifier"))
        missing = F.col("missing").bitwiseAND(bit) > 0
        found.append(scores.join(some, "doc_pos").filter(missing).select("doc_hash", *names(SCORE)))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def matching(docs: DataFrame, positions: DataFrame) -> DataFrame:
    """The documents at these positions, and perhaps a few more."""
    if is_small(positions):
        return docs.join(F.broadcast(positions), "doc_pos", "left_semi")
    built = bloom.filter_of(positions, "doc_pos", positions.count())
    return bloom.marked(docs, "doc_pos", built, "_maybe").filter("_maybe").drop("_maybe")


def score_unseen(docs: DataFrame, store: ScoreStore, dataset: str, scorers: list, model: NgramModel,
                 keys: DataFrame = None) -> None:
    """Score what the store lacks and commit it; a repeated call adds nothing.

    Only the missing scorers of a document run, and one of equal documents is scored. Texts on which an external
    model failed are not stored, so the next call tries them again. If another writer commits meanwhile, what is
    lacking is determined anew.
    """
    keys = listed_keys(docs) if keys is None else keys
    prefixes, scorers = prefixes_of(keys), chosen(scorers)
    called = [s.name for s in scorers]
    for _ in range(ATTEMPTS):
        state = store.table.state()
        wanted = lacking(keys, store.read(dataset, called, prefixes, state[1]), called)
        if wanted.isEmpty():
            return
        try:
            return store.append(fresh_scores(docs, wanted, scorers, model), dataset, state)
        except Conflict:
            continue
    raise Conflict(f"{store.path}: no commit in {ATTEMPTS} attempts")


def score_with_store(docs: DataFrame, store: ScoreStore, dataset: str, scorers: list, model: NgramModel) -> DataFrame:
    """Scores of all documents: stored ones reused, others scored once and stored.

    Only hash and scores come from the store; the metadata is that of the current documents.
    """
    keys = listed_keys(docs)
    score_unseen(docs, store, dataset, scorers, model, keys)
    kept = [c for c in names(SCORE) if c not in DOCUMENT_KEYS]
    stored = store.read(dataset, [s.name for s in chosen(scorers)], prefixes_of(keys)).select("doc_hash", *kept)
    return keys.drop("doc_pos").join(stored, "doc_hash").select("doc_hash", *names(SCORE))


class TextStore:
    """Texts of top documents by id, in folders per dataset."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self, dataset: str) -> DataFrame:
        rows = read_or_empty(self.spark, self.path, TEXTS)
        return rows.filter(F.col("dataset") == dataset).select("id", "text")

    def append(self, texts: DataFrame, dataset: str) -> None:
        rows = texts.select("id", "text", F.lit(dataset).alias("dataset"))
        rows.write.mode("append").partitionBy("dataset").parquet(self.path)

    def save_top(self, scores: DataFrame, docs: DataFrame, dataset: str, top_n: int = 100) -> DataFrame:
        """Store the texts of the best documents of each scorer; a stored text stays."""
        new = top_texts(scores, docs, top_n).join(self.read(dataset).select("id"), "id", "left_anti")
        self.append(new, dataset)
        return self.read(dataset)


# --- map-shaped JSON -----------------------------------------------------------------------------

FAIL = {"mode": "FAILFAST"}

SCORE_DDL = (
    "id: string, source: string, contains_benchmark: boolean, benchmark_type: string, benchmark_index: int, "
    "score: double, int_score: int, label: string, binary_pred: int, prob: double, rank_high: bigint, rank_low: bigint"
)


def parsed_map(text) -> Column:
    """The map of a JSON object from hash to score record."""
    return F.from_json(text, f"map<string,struct<{SCORE_DDL}>>")


def read_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """key, value of the entries of JSON objects, one object a file; what does not parse raises an error."""
    whole = F.concat(F.lit("{"), F.col("entry"), F.lit("}"))
    pairs = F.explode(F.from_json(whole, f"map<string,{value}>", FAIL))
    return json_maps.entries(spark, path).select(pairs.alias("key", "value"))


def read_score_json(spark: SparkSession, path: str, classifier: str, dataset: str) -> DataFrame:
    """Import objects from hash to score record, in any layout; other keys raise an error."""
    found = read_map(spark, path, f"struct<{SCORE_DDL}>")
    key = F.when(F.regexp_like("key", F.lit(r"\A[0-9a-f]{64}\z")), F.col("key")).otherwise(
        F.raise_error(F.concat(F.lit("no document hash: "), F.left("key", F.lit(200))))
    )
    return found.select(
        key.alias("doc_hash"), "value.*", F.lit(classifier).alias("classifier"), F.lit(dataset).alias("dataset")
    ).select(names(STORE))


def read_text_json(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """Import objects from id to text, in any layout."""
    found = read_map(spark, path, "string")
    return found.select(F.lit(dataset).alias("dataset"), F.col("key").alias("id"), F.col("value").alias("text"))
