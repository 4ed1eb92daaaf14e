import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quality_probe.functions import heads
from quality_probe.operators import ngram, ranking, scoring
from quality_probe.operators.ngram import SIGNALS, WEIGHTS, score_signals
from quality_probe.sources.web import as_documents, web_documents

BLANKS = re.compile("[ \n\t\r]+")


def tokens(text):
    return [w for w in BLANKS.split(text.lower()) if w]


def grams(words):
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def used(weight, gram):
    return {"all": True, "unigrams": " " not in gram, "bigrams": " " in gram}[WEIGHTS[weight][0]]


def learned(docs, labels):
    """Weight tables and unseen weights, by hand."""
    cells = {}
    for doc, quality, toxic in labels:
        for gram in grams(tokens(docs[doc])):
            cells.setdefault(gram, Counter())[f"n{quality}{toxic}"] += 1
    tables = {}
    for weight, (_, pos, neg) in WEIGHTS.items():
        kept = {g: c for g, c in cells.items() if used(weight, g)}
        h, low = (sum(c[n] for c in kept.values() for n in side) for side in (pos, neg))

        def odds(p, n, h=h, low=low, v=len(kept)):
            return round(1e6 * (math.log((p + 1) / (h + v)) - math.log((n + 1) / (low + v))))

        tables[weight] = (
            {g: odds(sum(c[n] for n in pos), sum(c[n] for n in neg)) for g, c in kept.items()}, odds(0, 0)
        )
    return tables


def views(text):
    words = tokens(text)
    return {"full": [words], "chunks": [words[i : i + 2046] for i in range(0, len(words), 2046)]}


def expected(text, tables):
    out = {}
    for signal, (view, weight) in SIGNALS.items():
        table, unseen = tables[weight]
        means = []
        for words in views(text)[view]:
            found = [g for g in grams(words) if used(weight, g)]
            if found:
                total = sum(table.get(g, unseen) for g in found)
                means.append(int(total / len(found)) if abs(total) < 2**52 else None)
        out[signal] = max(means) if means else None
    return out


@pytest.fixture(scope="module")
def tricky(spark):
    texts = {
        100: "", 101: "single", 102: "averyveryverylongsinglewordwithoutanyblank", 103: " lead and trail \n",
        104: "ab " * 4000, 105: "science words again " * 1500, 106: "x" * 25_000, 107: "good clean " * 1000 + "end",
        108: "w" * 9_990 + " science", 109: "a b c d e f g " * 2000,
    }
    return spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")


def test_weights_and_signals_match_brute_force(spark, raw, labels, model, tricky):
    docs = {r["doc_id"]: r["text"] for r in raw.collect()}
    tables = learned(docs, [tuple(r) for r in labels.collect()])
    for row in model.weights().collect():
        for weight, (table, _) in tables.items():
            assert row[weight] == table.get(row["gram"]), (weight, row["gram"])
    all_docs = raw.unionByName(tricky)
    found = score_signals(all_docs, model, carry=("doc_id",)).collect()
    texts = {r["doc_id"]: r["text"] for r in all_docs.collect()}
    assert len(found) == len(texts)
    for row in found:
        want = expected(texts[row["doc_id"]], tables)
        assert {s: row[s] for s in SIGNALS} == want, row["doc_id"]


def test_each_signal_alone_gives_the_same(spark, raw, model, tricky):
    docs = raw.unionByName(tricky)
    together = score_signals(docs, model, carry=("doc_id",))
    for signal in SIGNALS:
        alone = score_signals(docs, model, [signal], ("doc_id",))
        assert together.select("doc_id", signal).exceptAll(alone).isEmpty(), signal


@pytest.mark.parametrize("frequent, hottest", [(0, 1), (0, 10), (20, 5), (20, 10**9), (10**9, 10)])
def test_large_vocabulary_gives_the_same(raw, model, monkeypatch, frequent, hottest):
    docs, rows = web_documents(raw)
    small = score_signals(docs, model, carry=("id", "source"), exact=True)
    monkeypatch.setattr(ngram, "HOT_GRAMS", frequent)
    monkeypatch.setattr(ngram, "HOTTEST", hottest)
    large = score_signals(docs, model, carry=("id", "source"), max_rows=50, exact=True)
    assert small.exceptAll(large).isEmpty() and large.count() == rows


def test_large_vocabulary_moves_no_unknown_gram(raw, model, monkeypatch):
    tables = {}
    true_written = ngram.written
    monkeypatch.setattr(ngram, "written", lambda df, name: tables.setdefault(name, true_written(df, name)))
    monkeypatch.setattr(ngram, "HOT_GRAMS", 20)
    docs = raw.withColumn("text", F.concat(F.lit("unheard of grams beforehand "), "text"))
    ngram.split_looked_up(docs, model, ["quality"], "doc_id")
    left = tables["settled-segments"].select(F.explode("_open").alias("gram"))
    unknown = left.join(model.cells, "gram", "left_anti").count()
    assert left.count() > 100 and unknown < left.count() / 100


def test_many_labels_give_the_same_model(raw, labels, model, monkeypatch):
    monkeypatch.setattr(ngram, "is_small", lambda *a: False)
    large = ngram.train(web_documents(raw)[0], labels)
    assert large.totals == model.totals and large.cells.exceptAll(model.cells).isEmpty()


def test_exact_ratios(spark):
    pairs = [(7, 3), (-7, 3), (0, 5), (10**12 + 1, 2**31 - 1), (-(10**12) - 1, 2**31 - 2), (-1, 10**9), (5, 0)]
    df = spark.createDataFrame(pairs, "t bigint, n bigint")
    high, low = heads.exact_ratio("t", "n")
    for (t, n), row in zip(pairs, df.selectExpr(f"{high} AS h", f"{low} AS l").collect(), strict=True):
        assert (row.h, row.l) == ((None, None) if n == 0 else divmod(t * 2**62 // n, 2**62))


def test_shares_are_reached_by_the_exact_ratio(spark):
    """A logit just below that of 0.7 rounds to 0.7 and still lies below it."""
    found = spark.sql("SELECT 847297L AS q_high, 0L AS q_low UNION ALL SELECT 847298L, 0L UNION ALL SELECT NULL, NULL")
    shown = found.selectExpr(heads.probability("q_high") + " AS p", heads.reaches("q", 0.7) + " AS r").collect()
    assert [(row.p, row.r) for row in shown] == [(0.7, False), (0.7, True), (None, None)]
    assert found.filter(heads.reaches("q", 0)).count() == 2 and found.filter(heads.reaches("q", 1)).isEmpty()


def test_scores_that_round_to_one_are_told_apart(spark, model):
    """Two texts of unlike ratio but one shown score take unlike ranks; equal ratios share theirs."""
    rows = [(i, f"w{i}", total, grams) for i, (total, grams) in enumerate([(1, 3), (1, 2), (2, 6), (-1, 3)])]
    df = spark.createDataFrame(rows, "doc_pos bigint, id string, q_total bigint, q_grams bigint")
    high, low = heads.exact_ratio("q_total", "q_grams")
    keyed = df.selectExpr("*", "0L AS q", f"{high} AS q_high", f"{low} AS q_low")
    made = []
    for name, head in (("plain", heads.binary), ("label", heads.top_label), ("clamped", heads.edu_regression)):
        record = ", ".join(f"cast({v} AS {'double' if k == 'score' else 'bigint'}) AS {k}"
                           for k, v in head("q").items() if k in ("score", "rank_high", "rank_low"))
        made.append(keyed.selectExpr(f"'{name}' AS classifier", "id", "'web' AS source", "true AS contains_benchmark",
                                     "'t' AS benchmark_type", "1 AS benchmark_index", *record.split(", cast")[:1],
                                     *["cast" + part for part in record.split(", cast")[1:]]))
    scores = made[0].unionByName(made[1]).unionByName(made[2])
    assert scores.select("classifier", "score").distinct().count() == 3
    shared = {(r.classifier, r.id): r["rank"] for r in ranking.shared_ranks(scores).collect()}
    assert [shared["plain", f"w{i}"] for i in range(4)] == [2, 1, 2, 4]
    assert [shared["label", f"w{i}"] for i in range(4)] == [2, 1, 2, 2]
    assert [shared["clamped", f"w{i}"] for i in range(4)] == [2, 1, 2, 4]
    ordinal = {(r.classifier, r.id): r["rank"] for r in ranking.ordinal_ranks(scores).collect()}
    assert [ordinal["plain", f"w{i}"] for i in range(4)] == [2, 1, 3, 4]


def test_nine_scorers_judge_differently(spark):
    """Over real texts no two scorers give the same scores, nor the same order but where one signal is shown in two ways."""
    folder = "/root/testdata/sf0.001"
    docs, _ = web_documents(spark.read.parquet(f"{folder}/documents.parquet"))
    model = ngram.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scores = scoring.score_corpus(docs, model).toPandas().pivot(index="id", columns="classifier", values="score").dropna()
    for i, a in enumerate(scoring.NATIVE):
        for b in scoring.NATIVE[i + 1 :]:
            assert (scores[a] - scores[b]).abs().max() > 0.01, (a, b)
            if scoring.SCORERS[a].signals != scoring.SCORERS[b].signals:
                assert scores[a].rank().corr(scores[b].rank()) < 0.9999, (a, b)


def test_frequent_grams_stay_within_the_limit(model):
    for limit in (0, 1, 20, 500, 10**9):
        count = ngram.frequent_from(model.cells, limit)
        assert model.cells.filter(f"n00 + n01 + n10 + n11 >= {count}").count() <= limit


def test_grams_are_summed_before_the_shuffle(raw, model):
    plan = score_signals(raw, model, ["full_quality"], ("doc_id",))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and not any("gram" in line.split("hashpartitioning")[1].split(",")[0] for line in exchanges)


def test_all_scorers_give_a_row_per_document(raw, model):
    docs, rows = web_documents(raw)
    scores = scoring.score_corpus(docs, model)
    counts = {r["classifier"]: r["count"] for r in scores.groupBy("classifier").count().collect()}
    assert counts == {name: rows for name in scoring.NATIVE}
    blank = scores.filter("id = 'web_3'").select("score").distinct().collect()
    assert [r[0] for r in blank] == [None]


def test_registered_scorers_and_external_models(spark, raw, model):
    loads = spark.sparkContext.accumulator(0)

    def load():
        loads.add(1)
        return 2.0

    def predict(factor, texts):
        assert len(texts) <= 3
        if any(t == "x" for t in texts):
            raise RuntimeError("model failed")
        return [factor * len(t) for t in texts]

    scoring.register_scorer(scoring.ExternalScorer("lengths", load, predict, batch_size=3))
    try:
        docs, rows = web_documents(raw)
        scores = scoring.score_corpus(docs.coalesce(2), model, ["binary_ngram", "lengths"])
        assert scores.count() == 2 * rows
        found = {r["id"]: r["score"] for r in scores.filter("classifier = 'lengths'").collect()}
    finally:
        del scoring.SCORERS["lengths"]
    texts = {f"web_{r['doc_id']}": r["text"] for r in raw.collect()}
    assert found["web_2"] is None
    assert all(score in (None, 2.0 * len(texts[i])) for i, score in found.items())
    assert any(score is not None for score in found.values())


def test_positions_with_gaps_and_subset(spark, raw):
    sparse = raw.withColumn("doc_id", F.col("doc_id") * 3 + 5)
    docs, rows = web_documents(sparse, 7)
    assert rows == 7
    assert [r["doc_pos"] for r in docs.orderBy("doc_id").collect()] == list(range(7))
    some, rows = web_documents(raw, subset=F.col("doc_id") % 2 == 1)
    assert rows == 20
    assert [(r["doc_id"], r["id"]) for r in some.orderBy("doc_pos").limit(2).collect()] == [(1, "web_0"), (3, "web_1")]


def test_first_documents_are_cut_in_the_scan(spark, raw, tmp_path):
    raw.write.parquet(str(tmp_path / "docs"))
    docs, rows = web_documents(spark.read.parquet(str(tmp_path / "docs")), 5)
    plan = docs.select("id")._jdf.queryExecution().executedPlan().toString()
    assert rows == docs.count() == 5
    assert "LessThan(doc_id,5)" in plan and "ReadSchema: struct<doc_id:bigint>" in plan


@pytest.mark.parametrize("keys", [[0, 1, 1, 4, 4], [0, 1, 1, 9], [0, None, 1]])
def test_repeated_and_missing_keys_raise(spark, keys):
    with pytest.raises(ValueError):
        web_documents(spark.createDataFrame([(k, "x") for k in keys], "doc_id bigint, text string"))


def test_dense_keys_need_no_shuffle_of_texts(spark, raw):
    docs, _ = web_documents(raw)
    assert "Exchange" not in docs._jdf.queryExecution().executedPlan().toString()
    assert as_documents(raw.select(F.col("doc_id").alias("doc_pos"), "text")).columns == [c for c in docs.columns if c != "doc_id"]


def test_segments_are_settled_without_a_sort_or_shuffle(spark, raw, model, monkeypatch):
    plans = {}
    true_written = ngram.written

    def spied(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return true_written(df, name)

    monkeypatch.setattr(ngram, "written", spied)
    monkeypatch.setattr(ngram, "HOT_GRAMS", 20)
    monkeypatch.setattr(ngram, "RUN", 7)
    empty = spark.createDataFrame([(100, None), (101, "")], "doc_id bigint, text string")
    docs = raw.unionByName(empty)
    names = ["quality", "word_toxic", "pair_quality"]
    found = ngram.split_looked_up(docs, model, names, "doc_id")
    assert not any(word in plans["settled-segments"] for word in ("Exchange hash", "Sort", "Aggregate"))
    want = ngram.looked_up(docs, model, names, "doc_id").fillna(0, names)
    assert found.fillna(0, names).select(want.columns).exceptAll(want).isEmpty() and found.count() == want.count()


def test_packed_vocabulary_gives_the_same(spark, raw, labels, tricky, monkeypatch):
    """Counted and looked up by hash, in runs of few grams: the model, all ratios and the segments are the same."""
    docs = raw.unionByName(tricky).unionByName(spark.createDataFrame([(100, None), (101, "")], raw.schema)).repartition(3)
    marks = labels.unionByName(spark.createDataFrame([(25, None, 1), (26, 2, 0)], labels.schema))
    model = ngram.train(docs, marks)
    small = score_signals(docs, model, carry=("doc_id",), exact=True)
    monkeypatch.setattr(ngram, "PACKED_BYTES", 0)
    for run, hot in ((7, 0), (100, 1), (10**6, 128)):
        monkeypatch.setattr(ngram.packed, "PACKED_RUN", run)
        monkeypatch.setattr(ngram.packed, "HOT", hot)
        large = ngram.train(docs, marks)
        assert large.vocabulary is not None and large.cells.exceptAll(model.cells).isEmpty()
        assert {k: {n: v for n, v in t.items() if n != "bytes"} for k, t in model.totals.items()} == large.totals
        found = score_signals(docs, large, carry=("doc_id",), exact=True)
        assert small.exceptAll(found).isEmpty() and found.count() == small.count()
    names = list(WEIGHTS)
    words = ngram.tokens(F.col("text"))
    found = ngram.packed.summed(docs, large.vocabulary, words, "doc_id", names, large.lift_numbers(names), [ngram.ALL, ngram.BIGRAMS, ngram.UNIGRAMS])
    want = ngram.looked_up(docs, model, names, "doc_id").fillna(0, names)
    assert found.select(want.columns).exceptAll(want).isEmpty() and found.count() == want.count()


def test_packed_rows_carry_no_gram(spark, raw, labels, monkeypatch):
    """No plan explodes, sorts or shuffles grams, and a gram is asked for once a run."""
    plans, tables = [], {}
    true_written = ngram.packed.written

    def spied(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return tables.setdefault(name, true_written(df, name))

    monkeypatch.setattr(ngram, "PACKED_BYTES", 0)
    monkeypatch.setattr(ngram.packed, "HOT", 0)
    monkeypatch.setattr(ngram.packed, "written", spied)
    model = ngram.train(raw, labels)
    found = score_signals(raw.coalesce(1), model, carry=("doc_id",))
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert not any("Generate" in plan or "SortMergeJoin" in plan for plan in plans)
    asked = tables["packed-segments"].filter("bucket >= 0").agg(F.sum(F.octet_length("keys")) / 8).first()[0]
    want = ngram.occurrences(raw, "doc_id").filter("gram IS NOT NULL").select("gram").distinct().count()
    assert found.count() == 40 and asked == want
