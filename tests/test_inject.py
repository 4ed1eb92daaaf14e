import pytest
from pyspark.sql import functions as F

from quality_probe.operators import inject
from quality_probe.sources import benchmarks, items
from quality_probe.sources.web import web_documents

COUNTS = {"mmlu": {"count": 2, "subjects": items.SUBJECTS[:2]}, "gsm8k": {"count": 3}, "piqa": {"count": 9}}


def test_insert_borders_and_order(spark):
    df = spark.sql(
        "SELECT 'abcdefgh' AS text, array(named_struct('text', 'XX'), named_struct('text', 'YY'),"
        " named_struct('text', 'ZZZ')) AS items"
    )
    grown = df.select(inject.insert_all(F.col("text"), F.col("items"), 10)).first()[0]
    assert grown == "abcdef\n\nY\n\nZZZ\n\nY\n\ngh\n\nXX"
    for length, want in ((5000, "x" * 5000 + "\n\n!"), (5001, "x" * 2500 + "\n\n!\n\n" + "x" * 2501)):
        df = spark.sql(f"SELECT repeat('x', {length}) AS text")
        assert df.select(inject.insert(F.col("text"), F.lit("!"))).first()[0] == want


def test_ranges(spark):
    df = spark.range(8).selectExpr("cast(id AS int) AS p").select(
        inject.range_start(F.col("p"), 8, 1000), inject.range_end(F.col("p"), 8, 1000)
    )
    assert [tuple(r) for r in df.collect()] == [
        (0, 125), (125, 250), (250, 375), (375, 500), (500, 625), (625, 750), (750, 875), (875, 999)
    ]


def test_seeded_number(spark):
    column = inject.seeded_number(F.lit("42"), F.lit("mmlu"), F.lit("3"))
    assert spark.range(1).select(column).first()[0] == 943219758


@pytest.fixture(scope="module")
def sampled(item_table):
    frames = items.rows_by_type(item_table) | {"mmlu": items.rows_as(item_table, "mmlu")}
    return benchmarks.sampled_items(frames, COUNTS)


def test_samples_and_indexes(sampled):
    rows = sampled.orderBy("item_pos").collect()
    assert [r["item_pos"] for r in rows] == list(range(len(rows)))
    by_type = {}
    for r in rows:
        by_type.setdefault(r["benchmark_type"], []).append(r["benchmark_index"])
    assert by_type == {"mmlu": [0, 1, 2, 3], "gsm8k": [0, 1, 2], "piqa": [0, 1, 2]}
    assert [r["subject"] for r in rows[:4]] == ["anatomy", "anatomy", "computer_security", "computer_security"]


def test_strict_samples_raise(item_table):
    frames = items.rows_by_type(item_table)
    with pytest.raises(ValueError, match="larger"):
        benchmarks.load_samples(frames["gpqa"], "gpqa", 4)
    with pytest.raises(ValueError, match="requires subjects"):
        benchmarks.load_samples(frames["mmlu"], "mmlu", 1)
    with pytest.raises(ValueError, match="fewer than"):
        benchmarks.load_samples(frames["mmlu"], "mmlu", 50, items.SUBJECTS)
    with pytest.raises(ValueError, match="Unknown benchmark"):
        benchmarks.benchmark("nope")
    assert benchmarks.load_samples(frames["piqa"], "piqa", 50).count() == 3


def test_inject_inside_keeps_documents_and_last_item_wins(spark, raw):
    docs, rows = web_documents(raw)
    placed = spark.sql(
        "SELECT * FROM VALUES (0, 'mmlu', 0, 'law', 'M', 2L), (1, 'gsm8k', 4, NULL, 'G', 2L), (1, 'gsm8k', 5, NULL, 'H', 7L)"
        " AS t(type_pos, benchmark_type, benchmark_index, subject, text, doc_pos)"
    )
    found = {r["doc_pos"]: r for r in inject.inject_inside(docs, placed).collect()}
    assert len(found) == rows
    assert sorted(p for p, r in found.items() if r["contains_benchmark"]) == [2, 7]
    two = found[2]
    assert (two["benchmark_type"], two["benchmark_index"], two["benchmark_subject"]) == ("gsm8k", 4, "law")
    assert two["text"] == "x\n\nM\n\nG" and two["original_text"] == "x"
    assert found[7]["benchmark_subject"] is None and "\n\nH\n\n" in found[7]["text"]


def test_broadcast_and_shuffled_injection_agree(spark, raw, item_table, monkeypatch):
    docs, rows = web_documents(raw)
    config = {n: {"count": None, "subjects": items.SUBJECTS} for n in items.TYPES}
    placed = inject.placed_items(benchmarks.sampled_items(items.rows_by_type(item_table), config), rows, 8)
    small = inject.inject_inside(docs, placed)
    monkeypatch.setattr(inject, "is_small", lambda *a: False)
    assert small.exceptAll(inject.inject_inside(docs, placed)).isEmpty() and small.count() == rows


def test_separate_documents_follow_the_web(raw, sampled):
    docs, rows = web_documents(raw)
    found = inject.inject_separate(docs, sampled, rows)
    items_found = found.filter("contains_benchmark").orderBy("doc_pos").collect()
    assert items_found[0]["doc_pos"] == rows
    assert all(r["id"] == f"{r['benchmark_type']}_{r['benchmark_index']}" for r in items_found)
    log = inject.positions_separate(sampled, rows)
    assert log.count() == len(items_found) == found.count() - rows
