import hashlib
import json
import random

import numpy as np
import pytest

from quality_probe.llm import bpe, queries

PATH = queries.tokenizer_path(queries.BYTE_TOKENIZER)
PARTS = ["a", "b", "é", "ß", " ", "  ", "\n", "\t", " ", "　", "'s", "'ll", "12", "<|endoftext|>", "<|endo", "ftext|>",
         "the", " the", "Ж", "中", "😀", "\x1c", "\x85", "...", "!", "\r\n", " ", "ة"]


def texts():
    rng = random.Random(3)
    drawn = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    long = ["a" * 5001, "ab" * 3000, " " * 999, "\n" * 77 + "x", "héllo wörld " * 200_000, "x" * 3_000_000]
    return [None, "", "same", "same", *long, *drawn]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i % 50 else None, t, "k", b"c") for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[12]], "doc_id bigint, text string, ids string, n_tokens binary")


def library(values):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    ids = [e.ids for e in tokenizer.encode_batch(values, add_special_tokens=False)]
    return ids, [tokenizer.decode(i, skip_special_tokens=False) for i in ids]


def test_equals_the_library(docs):
    rows = [r["text"] or "" for r in docs.collect()]
    expected = []
    for row, ids, back in zip(docs.select("doc_id").collect(), *library(rows), strict=True):
        expected.append((row["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                         hashlib.sha256(back.encode()).hexdigest()))
    found = [tuple(r) for r in bpe.digests(docs.repartition(3), PATH).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)


def test_decodes_bytes_that_are_no_text(spark):
    ids = [[bpe.byte_pairs(PATH).byte_ids[b] for b in part] for part in (b"\xc3", b"a\xff\xfeb", b"")]
    rows = spark.createDataFrame([(np.array(i, "<u4").tobytes(),) for i in ids] + [(None,)], "ids binary")
    assert [r["text"] for r in bpe.decoded(rows, PATH, keep=()).collect()] == ["�", "a��b", "", ""]


def test_decodes_stored_ids(docs):
    stored = bpe.encoded(docs.repartition(3), PATH)
    expected = sorted((r["doc_id"], r["text"] or "") for r in docs.fillna(-1, "doc_id").collect())
    found = bpe.decoded(stored.fillna(-1, "doc_id"), PATH)
    assert sorted((r["doc_id"], r["text"]) for r in found.collect()) == expected


def test_empty_table(docs):
    assert bpe.digests(docs.limit(0), PATH).collect() == []


def test_refuses_other_files(tmp_path):
    with pytest.raises(ValueError):
        bpe.BytePairs(queries.tokenizer_path())
    described = json.load(open(PATH, encoding="utf-8"))
    described["model"]["merges"].insert(0, described["model"]["merges"][-1])
    path = tmp_path / "t.json"
    path.write_text(json.dumps(described), encoding="utf-8")
    with pytest.raises(ValueError, match="before its parts"):
        bpe.BytePairs(str(path))
