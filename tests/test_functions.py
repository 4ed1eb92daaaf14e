import hashlib
import re

from pyspark.sql import functions as F

from quality_probe.functions import heads, templates
from quality_probe.functions import text as T
from quality_probe.sources import benchmarks


def values(spark, column, *inputs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, text string")
    return [r[0] for r in df.select(column.alias("v"), "i").orderBy("i").select("v").collect()]


def test_newlines_and_labels(spark):
    assert values(spark, T.normalize_newlines("text"), "a\n\nb\nc") == ["a  b c"]
    assert values(spark, T.collapse_newlines("text"), "a\n\nb\nc") == ["a b c"]
    assert values(spark, T.strip_label("text"), "__label__educational", "__label__hq") == ["ducational", "hq"]


def test_doc_hash_is_sha256_of_id_and_text(spark):
    found = values(spark, T.doc_hash(F.lit("web_1"), F.col("text")), "Größe 🔴")
    assert found == [hashlib.sha256("web_1:Größe 🔴".encode()).hexdigest()]


def test_words(spark):
    assert values(spark, T.words("text"), " a  b\n\tc\r\n", "   ", "") == [["a", "b", "c"], [], []]
    assert values(spark, F.size(T.first_words("text")), "w " * 600) == [512]


def test_trims(spark):
    letters = "abcdefghijklmnopqrstuvwxy"
    assert values(spark, T.trim_end(F.col("text")), letters, "one two three", "short") == [letters[:15], "one two", ""]
    assert values(spark, T.trim_start(F.col("text")), letters, "one two three") == [letters[10:], "two three"]


def test_chunk_borders(spark):
    short, long = "ab " * 6666 + "cd", "ab " * 6667
    assert (len(short), len(long)) == (20_000, 20_001)
    assert values(spark, F.size(T.raw_chunks(F.col("text"))), short, long) == [1, 2]
    chunks = values(spark, T.raw_chunks(F.col("text")), long)[0]
    assert [len(c.split()) for c in chunks] == [2046, 2046]
    plain = "x" * 30_000
    assert values(spark, T.raw_chunks(F.col("text")), plain)[0] == ["x" * 10_000] * 2
    assert [len(c) for c in values(spark, T.chunks(F.col("text")), plain)[0]] == [9_990, 9_990]


def test_half_even_and_clamp(spark):
    df = spark.createDataFrame([(x,) for x in (0.5, 1.5, 2.5, 3.5)], "x double")
    assert [r[0] for r in df.selectExpr(heads.nearest("x")).collect()] == [0, 2, 2, 4]
    df = spark.createDataFrame([(-9_000_000,), (0,), (9_000_000,), (None,)], "m bigint")
    assert [r[0] for r in df.selectExpr(heads.regression("m")).collect()] == [0.0, 2.5, 5.0, None]


def head(spark, made, **micros):
    """What a head shows for logits of one gram each."""
    columns = ", ".join(
        f"{value} AS {name}, {value} AS {name}_total, 1L AS {name}_grams, cast({value} AS bigint) AS {name}_high, 0L AS {name}_low"
        for name, value in micros.items()
    )
    row = spark.sql(f"SELECT {', '.join(f'{sql} AS {name}' for name, sql in made.items())} FROM (SELECT {columns})").first()
    return row.asDict()


def shown(*args, **micros):
    return {name: value for name, value in head(*args, **micros).items() if not name.startswith("rank_")}


def test_heads(spark):
    assert shown(spark, heads.three_class("a", "b", "c"), a=0, b=0, c=0) == {"score": 0.5, "int_score": 2}
    assert shown(spark, heads.top_label("m"), m=1_000_000) == {"score": 0.731059, "label": "high_quality"}
    assert shown(spark, heads.top_label("m"), m=-1_000_000) == {"score": 0.731059, "label": "ow_quality"}
    assert shown(spark, heads.edu_binary("m"), m=0) == {"score": 2.5, "int_score": 2, "label": "high_quality"}
    assert shown(spark, heads.chunked("m"), m=-7_100_000) == {"score": -7.1, "int_score": 0}
    dual = shown(spark, heads.dual("m", "b"), m=500_000, b=-1)
    assert dual == {"score": 3.0, "int_score": 3, "binary_pred": 1, "prob": 0.5}
    assert set(shown(spark, heads.dual("m", "b"), m="NULL", b="NULL").values()) == {None}


def test_heads_rank_by_the_ratio(spark):
    def rank(made, m):
        found = head(spark, made, m=m)
        return found["rank_high"], found["rank_low"]

    assert rank(heads.binary("m"), -7) == rank(heads.chunked("m"), -7) == (-7, 0)
    assert rank(heads.top_label("m"), -7) == rank(heads.top_label("m"), 7) == (7, 0)
    assert rank(heads.edu_regression("m"), 7) == (7, 0) and rank(heads.edu_binary("m"), -2_500_001) == (-2_500_000, 0)
    assert rank(heads.edu_regression("m"), 2_500_001) == rank(heads.edu_regression("m"), 9_000_000) == (2_500_000, 0)
    assert rank(heads.binary("m"), "NULL")[0] is None
    softmax = head(spark, heads.three_class("a", "b", "c"), a=0, b=0, c=0)
    assert (softmax["rank_high"], softmax["rank_low"]) == (5 * 10**11, 0)


def test_templates(spark):
    row = spark.sql(
        "SELECT named_struct('question', 'Why {x}?', 'choices', array('p', 'q'), 'answer', 1) AS data, 'law' AS subject"
    )
    text = row.select(benchmarks.benchmark("mmlu").text()).first()[0]
    assert text == "Subject: law\nQuestion: Why {x}?\nA. p\nB. q\nAnswer: B"
    row = spark.sql("SELECT named_struct('ctx', 'C', 'endings', array('e'), 'label', 'zero') AS data, '' AS subject")
    assert row.select(benchmarks.benchmark("hellaswag").text()).first()[0].endswith("A. e\nAnswer: None")
    row = spark.sql(
        "SELECT named_struct('question', 'Q', 'choices', named_struct('label', array('1', '2'), 'text', array('a', 'b')),"
        " 'answerKey', '2') AS data, '' AS subject"
    )
    assert row.select(benchmarks.benchmark("arc_easy").text()).first()[0] == "Question: Q\n1. a\n2. b\nAnswer: 2"


def test_quoted_text_survives_sql(spark):
    nasty = "it's a \\ back\nslash \"quote\""
    assert spark.sql(f"SELECT {templates.quoted(nasty)}").first()[0] == nasty
    assert not re.search("\n", templates.quoted(nasty))
