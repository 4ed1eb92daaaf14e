"""Report folders of runs: a run is seen once all of its outputs are written, or not at all.

Each run writes into a folder of its own, so runs at one time do not meet. One commit then lists the folder with the
run's tags and outputs; a run that dies before it leaves nothing that is read.
"""

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quality_probe.sources import sinks
from quality_probe.sources.commits import Commits, Conflict

ATTEMPTS = 20

# Names of the reports.
RANKS, SCORES, RANKINGS = "benchmark_ranks_all_classifiers", "haystack_scores", "benchmark_rankings"
THRESHOLDS, STATS, EFFECT = "score_thresholds", "score_stats", "benchmark_effect"

READERS = {
    SCORES: lambda reader, path: reader.option("header", True).option("inferSchema", True).csv(path),
}


class Runs:
    """The committed runs of one folder."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self.commits = Commits(spark, self.base)

    def listed(self) -> list:
        """Tags of all committed runs, oldest first."""
        return self.commits.state()[1]

    def write(self, outputs: dict, injected: bool, prefiltered: bool, num_docs: int, dataset: str,
              now: datetime = None) -> str:
        """Write all outputs, then commit the run; its id. `outputs` maps a name to a function that writes a path."""
        run_id = f"{(now or datetime.now()).strftime('%Y%m%d_%H%M%S')}-{uuid.uuid4().hex[:8]}"
        suffix = sinks.run_suffix(injected, prefiltered, num_docs)
        for name, writes in outputs.items():
            writes(f"{self.base}/{run_id}/{name}{suffix}")
        run = {
            "run_id": run_id, "mode": "injected" if injected else "separate", "prefiltered": prefiltered,
            "num_docs": num_docs, "dataset": dataset, "suffix": suffix, "outputs": list(outputs),
        }
        for _ in range(ATTEMPTS):
            number, runs = self.commits.state()
            try:
                self.commits.commit(number, [*runs, run])
                return run_id
            except Conflict:  # another run has ended meanwhile
                continue
        raise Conflict(f"{self.base}: no commit in {ATTEMPTS} attempts")

    def read(self, name: str, run_id: str = None) -> DataFrame:
        """One output of a run, the latest one that has it if none is named, with the columns that tell runs apart."""
        found = [r for r in self.listed() if name in r["outputs"] and run_id in (None, r["run_id"])]
        if not found:
            raise LookupError(f"no committed run in {self.base} has {name}")
        run = found[-1]
        read = READERS.get(name, lambda reader, path: reader.json(path))
        rows = read(self.spark.read, f"{self.base}/{run['run_id']}/{name}{run['suffix']}")
        tagged = sinks.tagged(rows, run["run_id"], run["mode"] == "injected", run["prefiltered"], run["num_docs"])
        return tagged.withColumn("dataset", F.lit(run["dataset"]))
