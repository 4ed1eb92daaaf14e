import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np

import corpus_pipeline
from quality_probe.llm import mixing, packing, queries

SHAPE = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus():
    """Fewer documents than quality's MIN_GROUP: of the quality rules only the base rules apply."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(5000)]
    rows = []
    for i in range(90):
        words = [rng.choice(vocabulary) for _ in range(10 if i % 9 == 4 else rng.randint(500, 1500))]
        if i % 10 == 3:
            words[7] = "AKIA" + "A1" * 9
        source = None if i % 30 == 7 else "abaacaabaa"[i % 10]
        rows.append((i, " ".join(words), "en", source, 0))
    rows += [(100 + i, rows[i][1] + " tail", "en", "c", 0) for i in (5, 6, 8)]
    rows += [(200 + i, None, "en", "a", 0) for i in range(2)]
    return rows


def expected(rows, draws, length=packing.LENGTH):
    """All pieces, by loops over documents, windows and sources."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    rows = [r for r in rows if len((r[1] or "").split()) >= 50]  # words are random: no repeats
    sets = {r[0]: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for r in rows for w in [r[1].split()]}
    gone = {y for x in sets for y in sets if x < y and 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y])}
    rows = [r for r in rows if r[0] not in gone]
    queues = defaultdict(list)
    for doc, text, _, source, _ in sorted(rows, key=lambda r: (draws[r[0]], r[0])):
        text = re.sub(r"AKIA[A-Z0-9]{16,}", "[SECRET]", text)
        queues[source].append((doc, [*tokenizer.encode(text, add_special_tokens=False).ids, packing.END]))
    weight = {s: len(q) ** mixing.TEMPER for s, q in queues.items()}
    parts = {s: max(1, round(packing.PARTS * weight[s] / sum(weight.values()))) for s in weight}
    streams = {s: [(doc, k, t, len(ids)) for doc, ids in q for k, t in enumerate(ids)] for s, q in queues.items()}
    credit, at = Counter(), Counter()
    placed, window = [], 0
    while any(at[s] < len(streams[s]) for s in streams):
        for s in sorted(streams, key=lambda s: (s is not None, s)):
            credit[s] += Fraction(parts[s] * packing.WINDOW, packing.PARTS)
            units = credit[s] // packing.UNIT
            credit[s] -= units * packing.UNIT
            end = min(len(streams[s]), at[s] + units * packing.UNIT)
            placed += [(*x, window) for x in streams[s][at[s] : end]]
            at[s] = end
        window += 1
    pieces = defaultdict(list)
    for p, (doc, k, t, n, w) in enumerate(placed):
        pieces[doc, w, p // length, n].append((k, t, p % length))
    return sorted(
        (doc, found[0][0], len(found), zlib.crc32(np.array([t for _, t, _ in found], "<u4").tobytes()), n, q, found[0][2], w)
        for (doc, w, q, n), found in pieces.items()
    )


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame(rows, SHAPE).repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    draws = {r[0]: r[1] for r in docs.selectExpr("doc_id", "xxhash64(doc_id, 42)").collect()}
    found = sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert found == expected(rows, draws)
    assert len({r[7] for r in found}) > 1  # the weights show


def test_stored_order(spark, tmp_path):
    many = spark.range(1000).repartition(5).selectExpr("id", "repeat('x', id % 700) AS text")
    many.repartitionByRange(7, "id").sortWithinPartitions("id").write.parquet(str(tmp_path / "sorted"))
    found = mixing.stored_order(spark.read.parquet(str(tmp_path / "sorted")), "place").collect()
    assert len(found) == 1000 and all(r.place == r.id for r in found)
