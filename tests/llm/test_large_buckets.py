import numpy as np
import pytest

from quality_probe.llm import ngram_join as J
from quality_probe.llm.components import components


def minima(changed, members, seed):
    """Sketches of members that each differ from one base in `changed` coordinates."""
    rng = np.random.default_rng(seed)
    out = np.repeat(rng.integers(0, 1 << 32, (1, J.COORDINATES), dtype=np.uint32), members, axis=0)
    for row in out:
        at = rng.choice(J.COORDINATES, changed, replace=False)
        row[at] = rng.integers(0, 1 << 32, changed, dtype=np.uint32)
    return out


@pytest.fixture
def carried(monkeypatch):
    """How many rows each split below a run's first bucket makes."""
    made, split = [], J.split

    def counted(rows, roots):
        found = split(rows, roots)
        if not roots:
            made.append(found.count())
        return found

    monkeypatch.setattr(J, "split", counted)
    return made


def classes_of(spark, mins):
    rows = [(i, bytearray(m.tobytes())) for i, m in enumerate(mins)]
    return spark.createDataFrame(rows, "_id bigint, mins binary").repartition(3, "_id").cache()


def test_near_copies_leave_a_large_bucket(spark, carried):
    mins = np.concatenate([minima(5, 300, 1), minima(J.COORDINATES, 100, 2)])
    found = components(J.candidates(classes_of(spark, mins))).collect()
    assert sum(carried) < len(mins)
    assert {r.node for r in found if r.root == 0} >= set(range(300))


def test_those_like_a_leaving_one_are_linked_or_stay(spark, carried):
    core = minima(4, 200, 3)
    rim = core[:60].copy()  # each is like one of the core, few are like a leader
    rng = np.random.default_rng(4)
    for row in rim:
        at = rng.choice(J.COORDINATES, 13, replace=False)
        row[at] = rng.integers(0, 1 << 32, 13, dtype=np.uint32)
    roots = {r.node: r.root for r in components(J.candidates(classes_of(spark, np.concatenate([core, rim])))).collect()}
    assert all(roots[200 + i] == roots[i] for i in range(60))
