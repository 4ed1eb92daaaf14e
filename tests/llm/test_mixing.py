from quality_probe.llm import mixing

CLASHING = ["_row", "_slice", "_draw", "_border", "_borders", "_first", "_at", "row_number", "block", "slot", "parts", "turn"]


def rows():
    """Unequal sources, a null one, null and repeated ids."""
    out = [(i, f"text {i}", None if i % 50 == 9 else "abcaadaaaa"[i % 10]) for i in range(600)]
    return out + [(None, f"none {i}", "a") for i in range(4)] + [(17, "again", "b"), (17, "again", "a")]


def test_moved_texts_follow_the_schedule(spark, tmp_path):
    docs = spark.createDataFrame(rows(), "doc_id bigint, text string, source string").repartition(3)
    docs = docs.selectExpr("*", *[f"concat(text, '{c}') AS `{c}`" for c in CLASHING])
    for slices in (1, 7):
        path = str(tmp_path / f"mixed{slices}")
        mixing.mixed_documents(docs, slices=slices).write.parquet(path)
        stored = spark.read.parquet(path)
        found = mixing.stored_order(stored, "place").orderBy("place").collect()
        want = mixing.mix(docs).orderBy("position").collect()
        assert stored.columns == docs.columns
        assert all(r[c] == r["text"] + c for r in found for c in CLASHING)
        assert sorted(r["text"] for r in found) == sorted(r[1] for r in rows())
        pairs = [(r["doc_id"], r["source"]) for r in found]
        assert pairs == [(r["doc_id"], r["source"]) for r in want]


def test_texts_move_once(spark):
    docs = spark.createDataFrame(rows(), "doc_id bigint, text string, source string")
    plan = mixing.mixed_documents(docs, slices=7)._jdf.queryExecution().executedPlan().toString()
    moving = [line for line in plan.split("\n") if "Exchange" in line and "rangepartitioning" in line]
    assert len(moving) == 1 and "SortMergeJoin" not in plan


def test_an_empty_table_is_mixed(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert mixing.mixed_documents(empty).count() == 0
