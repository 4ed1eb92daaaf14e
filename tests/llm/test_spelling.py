import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quality_probe.llm import spelling

SHAPE = "doc_id bigint, text string, word string, n string"


def table():
    rng = random.Random(4)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(5, 9))) for _ in range(60)]
    base += ["pots" * 3, "stop" * 3, "abcdef" * 50, "ÉÉÉÉÉÉ", "÷×÷×÷×÷"]

    def variant(word):
        at = rng.randrange(len(word))
        return word[:at] + rng.choice(["", "a", "Bé", "É", "×", "÷"]) + word[at + 1 :]

    rows = [(0, None), (1, ""), (2, " 12 ??"), (None, "abcabc " * 9), (3, "abcabc " * 400), (3, "abcabc " * 400)]
    for d in range(4, 300):
        words = [rng.choice(base[: 10 + rng.randint(0, 55)]) for _ in range(120)]
        words = [variant(w) if rng.random() < 0.3 else w for w in words]
        rows.append((d if d % 37 else None, " ".join(w.upper() if rng.random() < 0.1 else w for w in words)))
    rows.append((1000, "wörterbuch " * 200_000))
    return [(*row, "w", "n") for row in rows]


def brute(rows):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    kept = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = defaultdict(set)
    for a in kept:
        for b in kept:
            if len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1:
                near[a].add(b)
            if len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b))):
                near[a].add(b)
                near[b].add(a)
    form = {}
    for word, n in kept.items():
        best = min(near[word], key=lambda o: (-kept[o], o), default=None)
        if best and kept[best] >= 5 * n:
            form[word] = best
    out = []
    for word, n in kept.items():
        root = word
        while root in form:
            root = form[root]
        out.append((word, form.get(word), root, n, len(near[word]), kept.get(form.get(word))))
    return sorted(out)


@pytest.mark.parametrize("cell", [spelling.CELL, 400])
def test_equals_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(spelling, "CELL", cell)
    monkeypatch.setattr(spelling, "LEAST_CELL", 4)
    rows = table()
    docs = spark.createDataFrame(rows, SHAPE).repartition(3)
    assert sorted(tuple(r) for r in spelling.grouped(docs).collect()) == brute(rows)


def test_equal_vectors_are_shared_out(monkeypatch):
    """Anagrams beyond a cell's size: each is a member once and asks in all shares that it reaches."""
    monkeypatch.setattr(spelling, "CELL", 60)
    monkeypatch.setattr(spelling, "LEAST_CELL", 4)
    words = sorted({"".join(random.Random(i).sample("abcdef", 6)) for i in range(200)}) + ["abcdeg"]
    cells = spelling.Cells({6: len(words)}, words)
    homes, asked = {}, defaultdict(set)
    for cell, role, rows in cells.places(words):
        for c, r, i in zip(cell.tolist(), role.tolist(), rows.tolist(), strict=True):
            assert r != spelling.MEMBER or homes.setdefault(i, c) == c
            asked[i].add(c)
    anagrams = {homes[i] for i in range(len(words) - 1)}
    assert len(homes) == len(words) and len(anagrams) > 10
    assert asked[len(words) - 1] >= anagrams


def test_pruning_loses_no_vector():
    rng = np.random.default_rng(1)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 4, 8)) for _ in range(900)]
    counts = spelling.vectors(words)
    tree = spelling.Tree(counts, 16)
    reached = defaultdict(set)
    for leaf, rows in tree.reached(counts, 2):
        for row in rows.tolist():
            reached[row] |= set(tree.leaves[leaf].tolist())
    signs = spelling.signatures(counts)
    for i in range(0, 900, 9):
        distance = np.abs(counts[:, i : i + 1].astype(int) - counts).sum(axis=0)
        assert set(np.flatnonzero(distance <= 2).tolist()) <= reached[i]
        assert (np.bitwise_count(signs ^ signs[i]) <= distance).all()
    assert np.mean([len(r) for r in reached.values()]) < 700


def test_empty_table(spark):
    assert spelling.grouped(spark.createDataFrame([], SHAPE)).collect() == []
    assert spelling.grouped(spark.createDataFrame([(1, "few words only", "", "")], SHAPE)).collect() == []
