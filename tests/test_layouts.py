"""Queries on small tables of their own, against their statements."""

import duckdb
import pytest

import __spark_entry__ as entry

WORDS = ["science", "spam", "river", "stone", "Buy", "good", "clean", "table", "lamp", "ÄÖ"]


def tables(spark, folder, files: int) -> str:
    """A folder of tables; `documents.parquet` is one file, or a folder of `files` of them."""
    docs = [(i, " ".join(WORDS[(i * k) % 4 + 3 * (i // 2 % 2) + k % 4] for k in range(1, 9 + i % 5)), "en", "s", 40) for i in range(48)]
    shape = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    frames = {
        "documents": spark.createDataFrame(docs, shape),
        "benchmark": spark.createDataFrame([(i, f"item {i} of stone and river {i % 5}") for i in range(16)], "item_id bigint, text string"),
        "labels": spark.createDataFrame([(i, i // 2 % 2, int(i % 3 == 1)) for i in range(0, 48, 2)], "doc_id bigint, quality int, toxic int"),
    }
    for name, df in frames.items():
        path = folder / f"{name}.parquet"
        if name == "documents" and files > 1:
            df.repartitionByRange(files, "doc_id").write.parquet(str(path))
        else:
            df.toPandas().to_parquet(path, index=False)
    return str(folder)


@pytest.mark.parametrize("files", [1, 3])
@pytest.mark.parametrize("name", ["score_top_label", "stream_prefilter", "stream_prefilter_first", "stream_score_store"])
def test_query_equals_statement_for_a_file_and_a_folder(spark, tmp_path, name, files):
    folder = tables(spark, tmp_path, files)
    db = duckdb.connect()
    for table in ("documents", "benchmark", "labels"):
        parts = "/*.parquet" if files > 1 and table == "documents" else ""
        db.execute(f"CREATE VIEW {table} AS FROM read_parquet('{folder}/{table}.parquet{parts}')")
    found = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    df = entry.queries()[name](spark, folder)
    assert sorted(columns) == sorted(df.columns)
    want = sorted(found.fetchall(), key=repr)
    got = sorted((tuple(r) for r in df.select(columns).collect()), key=repr)
    assert got == want and got
