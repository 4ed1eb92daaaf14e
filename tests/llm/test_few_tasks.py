"""Rounds over few rows take few tasks, however many shuffle partitions are set."""

import numpy as np
import pytest

from quality_probe.llm import components, quality


@pytest.fixture
def many_partitions(spark):
    setting = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in setting}
    for k, v in setting.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def spied(monkeypatch, module, most: dict):
    true_written = module.written

    def write(df, name):
        out = true_written(df, name)
        most.setdefault(name, []).append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(module, "written", write)


def test_components_of_few_edges(spark, many_partitions, monkeypatch):
    files = {}
    spied(monkeypatch, components, files)
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    found = components.components(spark.createDataFrame(edges, "a bigint, b bigint"))
    want = {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert sorted(map(tuple, found.select("node", "root").collect())) == sorted(want.items())
    assert max(files["labels"]) == 1


def test_estimates_of_few_groups(spark, many_partitions, monkeypatch):
    files = {}
    spied(monkeypatch, quality, files)
    x = np.random.default_rng(3).normal(size=(240, len(quality.DIMENSIONS))).tolist()
    rows = [(f"g{i % 2}", i, *x[i]) for i in range(len(x))]
    shape = "_group string, _copy bigint, " + ", ".join(f"{d} double" for d in quality.DIMENSIONS)
    found = quality.estimates(spark.createDataFrame(rows, shape).repartition(3)).collect()
    assert sorted(r["_group"] for r in found) == ["g0", "g1"]
    assert all(np.abs(r["centre"]).max() < 1 for r in found)
    assert max(files["mcd-limits"]) <= 4
