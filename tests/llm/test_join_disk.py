"""The join's disk follows its rows: files go when read, sets are shipped by blocks, work is dealt in parts."""

import glob
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quality_probe import scratch
from quality_probe.llm import ngram_join as J


def shuffle_files(spark) -> int:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def tables(spark, name) -> list:
    return glob.glob(scratch.shared_folder(spark).removeprefix("file://") + f"/quality_probe/{name}-*")


@pytest.fixture(scope="module")
def groups(spark):
    """Forty groups of 30 near copies over a shared start, of very different lengths, with exact copies and gaps."""
    rng = np.random.default_rng(7)
    start = [f"start{i}" for i in range(30)]
    texts = []
    for g in range(40):
        base = start + [f"g{g}w{i}" for i in range(int(rng.integers(1, 200)))]
        for _ in range(30):
            words = list(base)
            for at in rng.choice(len(words), int(rng.integers(0, 3)), replace=False):
                words[at] = f"x{rng.integers(1000)}"
            texts.append(" ".join(words))
    rows = [*enumerate(texts), (None, texts[0]), (5000, None), (5001, " "), (5, texts[5])]
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).cache()


def brute(docs) -> dict:
    """Links of each text."""
    sets = {}
    for text, in docs.select("text").distinct().collect():
        words = (text or "").split()
        if words:
            sets[text] = {tuple(words[i : i + J.SIZE]) for i in range(max(1, len(words) - J.SIZE + 1))}
    own = list({frozenset(s) for s in sets.values()})
    links = {s: sum(s is not t and 9 * len(s & t) >= 4 * (len(s) + len(t)) for t in own) for s in own}
    return {t: links[frozenset(s)] for t, s in sets.items()}


def test_shuffle_files_go_with_the_write(spark):
    before = shuffle_files(spark)
    found = scratch.written(spark.range(1000).repartition(3, "id").groupBy(F.col("id") % 7).count(), "freed")
    assert len(found.collect()) == 7
    for _ in range(50):
        if (now := shuffle_files(spark)) <= before:
            break
        time.sleep(0.1)
    assert now <= before
    assert spark.conf.get(scratch.FREED, None) is None


def test_a_component_ships_each_set_once(spark, groups, monkeypatch):
    shipped, verified = [], J.verified
    monkeypatch.setattr(J, "verified", lambda sets: shipped.append(sets.count()) or verified(sets))
    monkeypatch.setattr(J, "components", lambda edges: whole(edges.sparkSession, groups))
    found = J.joined(groups).select("doc_id", "n_links").where("doc_id < 1200").collect()
    assert shipped == [J.numbered(groups).count() - 4 - repeats(groups)]
    want = brute(groups)
    text = dict(groups.where("doc_id < 1200").select("doc_id", "text").collect())
    assert all(r.n_links == want[text[r.doc_id]] for r in found)


def whole(spark, docs):
    """All classes as one candidate component."""
    sets = J.described(J.numbered(docs)).where("n > 0").groupBy("class_a", "class_b").agg(F.min("_id").alias("node"))
    return sets.select("node", F.lit(0).cast("bigint").alias("root"))


def repeats(docs) -> int:
    """Texts of an id below 1200 that have an earlier equal one."""
    return 1200 - docs.where("doc_id < 1200").select("text").distinct().count()


def test_parts_give_the_same_rows(spark, groups, monkeypatch):
    want = sorted(map(str, J.joined(groups).collect()))
    for name, value in (("ROWS", 20_000), ("MEMBERS", 20), ("SHIPPED", 6_000_000), ("SHARE", 0), ("BLOCK", 16)):
        monkeypatch.setattr(J, name, value)
    levels, verified = [], []
    for name, calls in (("level", levels), ("verified", verified)):
        monkeypatch.setattr(J, name, lambda *a, own=getattr(J, name), calls=calls: calls.append(1) or own(*a))
    assert sorted(map(str, J.joined(groups).collect())) == want
    assert len(levels) > 1 and 1 < len(verified) < 12


def test_tables_go_when_read(spark, groups):
    names = ("paths", "path-sizes", "led", "sketches", "class-minima", "members", "verified")
    before = {n: len(tables(spark, n)) for n in names}
    J.joined(groups).collect()
    assert {n: len(tables(spark, n)) for n in names} == before


def test_sizes_alone_rule_pairs_out(monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 4)
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.choice(n + n // 6 + 1, n, replace=False).astype(np.uint64)) for n in rng.integers(1, 60, 80)]
    sets = sorted(sets, key=len)
    share = lambda a, b: 9 * len(np.intersect1d(a, b)) >= 4 * (len(a) + len(b))
    seen, similar = [], J.similar
    monkeypatch.setattr(J, "similar", lambda a, b: seen.append(1) or similar(a, b))
    assert sorted(J.pairs(sets)) == [[i, j] for i in range(80) for j in range(i + 1, 80) if share(sets[i], sets[j])]
    assert len(seen) < 20 * 21 / 2
    left, right = sets[::2], sets[1::2]
    assert sorted(J.pairs(left, right)) == [[i, j] for i in range(40) for j in range(40) if share(left[i], right[j])]


def test_near_duplicates_of_the_pipeline_free_their_tables(spark, groups):
    from corpus_pipeline import near_duplicates

    names = ("paths", "path-sizes", "led", "sketches", "class-minima", "members", "verified")
    before = {n: len(tables(spark, n)) for n in names}
    kept = {r.doc_id for r in near_duplicates(spark, groups, "").collect()}
    assert {n: len(tables(spark, n)) for n in names} == before
    first = J.joined(groups).where("doc_id IS NOT NULL").groupBy("class_id").agg(F.min("doc_id")).collect()
    assert kept == {r[1] for r in first}
