"""Incremental jobs over an unbounded document folder."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quality_probe.functions import heads
from quality_probe.operators.ngram import NgramModel, score_signals
from quality_probe.operators.ordering import number_rows, without_slices
from quality_probe.operators.sizes import broadcast_if_small
from quality_probe.scratch import written
from quality_probe.sources.stores import ScoreStore, score_unseen
from quality_probe.sources.web import QUALITY, as_documents

POLL = 1  # seconds between looks at whether a stream may stop


def document_stream(spark: SparkSession, folder: str, schema, glob: str = "*.parquet", files: int = 100) -> DataFrame:
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files)
        .parquet(folder)
    )


def run(stream: DataFrame, each, checkpoint: str, finished=None) -> None:
    """Process what is available now, batch by batch, and stop; earlier if `finished()` says so after a batch."""
    query = (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    while not query.awaitTermination(POLL):
        if finished is not None and finished():
            query.stop()  # a batch that this interrupts is not committed, so it is replayed
            return


def accepted(docs: DataFrame, model: NgramModel, min_score: float, key: str = "doc_id", most: int = None) -> DataFrame:
    """Documents whose quality probability reaches `min_score`; each is judged by itself.

    With `most`, those of the least keys. Texts do not move while the accepted keys are few enough to be sent out.
    """
    scores = score_signals(docs, model, [QUALITY], [key], exact=True).filter(heads.reaches(QUALITY, min_score)).select(
        key, F.expr(heads.probability(QUALITY)).alias("original_score")
    )
    kept = written(scores, "accepted-batch")
    if most is not None and kept.count() > most:
        kept = without_slices(number_rows(kept, [], [key], "_number")).filter(F.col("_number") <= most).drop("_number")
    return docs.join(broadcast_if_small(kept), key)


def prefilter_stream(stream: DataFrame, model: NgramModel, sink: str, checkpoint: str, min_score: float,
                     key: str = "doc_id", num_docs: int = None) -> None:
    """Write the accepted documents, the first `num_docs` of them if given; a replayed batch overwrites its own folder.

    The number accepted up to each batch lies in the checkpoint's folder, so a replay and a restart go on from the
    count before them. Once it reaches `num_docs` nothing more is scored and the query stops. First are those of the
    earliest batches, and in a batch those of the least keys.
    """
    counted = f"{checkpoint}/accepted-counts"
    reached = []

    def count_before(spark: SparkSession, batch_id: int) -> int:
        return spark.read.parquet(f"{counted}/{batch_id - 1}").first()["accepted"] if batch_id else 0

    def each(batch: DataFrame, batch_id: int) -> None:
        spark, folder = batch.sparkSession, f"{sink}/batch={batch_id}"
        if num_docs is None:
            accepted(batch, model, min_score, key).write.mode("overwrite").parquet(folder)
            return
        total = count_before(spark, batch_id)
        if not batch_id or total < num_docs:
            accepted(batch, model, min_score, key, num_docs - total).write.mode("overwrite").parquet(folder)
            total += spark.read.parquet(folder).count()
        spark.createDataFrame([(total,)], "accepted bigint").write.mode("overwrite").parquet(f"{counted}/{batch_id}")
        if total >= num_docs:
            reached.append(batch_id)

    run(stream, each, checkpoint, lambda: bool(reached))


def score_stream(stream: DataFrame, model: NgramModel, store: ScoreStore, dataset: str, scorers: list,
                 checkpoint: str, key: str = "doc_id") -> None:
    """Score each unseen document once over all batches and runs; ids come from the key."""

    def each(batch: DataFrame, batch_id: int) -> None:
        docs = as_documents(batch.select(F.col(key).alias("doc_pos"), "text"))
        score_unseen(docs, store, dataset, scorers, model)

    run(stream, each, checkpoint)
