import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[*]")
        .appName("quality_probe tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def raw(spark):
    """Documents with gaps in no key: long, short, blank, single-word and repeated texts."""
    texts = [
        "good clean words about science and science again",
        "bad spam words buy now buy now",
        "x",
        "   ",
        "one two three\nfour\tfive\r\nsix",
        "Mixed CASE Words and ÄÖÜ Straße",
        " ".join(f"word{i % 97}" for i in range(3000)),
        " ".join(f"long{i % 53} science" for i in range(1500)),
        "averyveryverylongsinglewordwithoutanyblank",
        "good clean words about science and science again",
    ]
    rows = [(i, texts[i % len(texts)]) for i in range(40)]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, int(i % 10 in (0, 4, 6, 9)), int(i % 7 == 1)) for i in range(25)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="session")
def item_table(spark):
    rows = [(i, f"Question {i} about science\nand what{i} words mean now") for i in range(24)]
    return spark.createDataFrame(rows, "item_id bigint, text string")


@pytest.fixture(scope="session")
def model(raw, labels):
    from quality_probe.operators.ngram import train
    from quality_probe.sources.web import web_documents

    return train(web_documents(raw)[0], labels)
