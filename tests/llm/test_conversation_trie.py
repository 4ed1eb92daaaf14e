import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from quality_probe.llm import conversation_trie

SHAPE = "conv_id bigint, turn bigint, role string, text string, depth string, ids binary"


def table():
    rng = random.Random(2)
    rows = [(None, 1, "u", "of no conversation")]
    for conv in [*range(330), 1005, 5000, 77777, 9_900_000_000]:
        for turn in range(400 if conv == 100 else rng.randint(1, 8)):
            number = turn if turn or rng.random() > 0.1 else None
            rows.append((conv, number, "u" if turn % 2 else rng.choice(["a", None]), rng.choice(["hi", "yo", None, "é😀"])))
    long = [(turn, "u", "x" * (turn % 7)) for turn in range(60)]
    for conv in range(2000, 2090):  # copies, and conversations that end within others
        rows += [(conv, *turn) for turn in long[: rng.choice([60, 59, 30])]]
    rows += [(7001, 1, "u", "twice"), (7001, 1, "u", "twice"), (7001, 2, "a", "m" * 3_000_000)]
    return [(*row, "d", b"i") for row in rows]


def brute(rows):
    stored = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            stored[conv].append((turn is not None, turn or 0, role or "", text or ""))
    stored = {conv: [turn[2:] for turn in sorted(turns)] for conv, turns in stored.items()}
    rebuilt, members = {}, defaultdict(list)
    for conv, own in stored.items():
        cut = zlib.crc32(str(conv).encode()) % 6
        rebuilt[conv] = stored.get(conv - conv % 100, [])[:cut] + own[cut:]
        for depth in range(len(rebuilt[conv]) + 1):
            members[tuple(rebuilt[conv][:depth])].append(conv)
    sums = defaultdict(lambda: [0, 0, 0])  # children, leaves, saved
    for node in sorted(members, key=len, reverse=True):
        sums[node][1] += sums[node][0] == 0
        sums[node][2] += (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        if node:
            above = sums[node[:-1]]
            for i, more in enumerate((1, *sums[node][1:])):
                above[i] += more
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(rebuilt[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), *sums[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda row: row[:2])


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_equals_brute_force(spark, coalesce):
    """Without coalescing, a long conversation lies in several slices."""
    rows = table()
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, coalesce)
    try:
        found = conversation_trie.trie(spark.createDataFrame(rows, SHAPE).repartition(5)).collect()
    finally:
        spark.conf.unset(key)
    assert sorted((tuple(r) for r in found), key=lambda row: row[:2]) == brute(rows)


def test_collisions_are_found_and_drawn_anew(spark, monkeypatch):
    """Content hashes of one attempt that agree for all turns must not join different texts."""
    rows = [(1, 1, "u", "one"), (2, 1, "u", "two"), (3, 1, "u", "one")]
    true_contents = conversation_trie.contents

    def poor(conversations, seed):
        found = true_contents(conversations, seed)
        return found.selectExpr("conv_id", "turn", "role", "text", "1L AS x1", "1L AS x2") if seed == 0 else found

    monkeypatch.setattr(conversation_trie, "contents", poor)
    conversations = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    found = sorted((tuple(r) for r in conversation_trie.trie(conversations).collect()), key=lambda row: row[:2])
    assert found == brute(rows)


def test_ids_join_over_slices():
    import pyarrow as pa

    rows = [[1, 1, 1, 1, c] for c in range(5)] + [[1, 1, 1, 2, 9]]
    columns = [*conversation_trie.NODE, "conv_id"]
    batches = [pa.RecordBatch.from_pydict(dict(zip(columns, map(list, zip(*rows[i : i + 2])), strict=True))) for i in (0, 2, 4)]
    joined = list(conversation_trie.joined_ids(batches))
    hashes = [h for b in conversation_trie.hashed_ids(joined) for h in b.column("ends_sha256").to_pylist()]
    assert hashes == [hashlib.sha256(b"0,1,2,3,4").hexdigest(), hashlib.sha256(b"9").hexdigest()]


def test_empty_table(spark):
    assert conversation_trie.trie(spark.createDataFrame([], SHAPE)).collect() == []
