import random

import numpy as np
import pytest

from quality_probe.llm import quality

SHAPE = "doc_id bigint, text string, lang string, source string"


def prose(rng, n=80):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]) + str(rng.randrange(99)) for _ in range(n))


def junk(rng, n=80):
    return "### ".join(f"w{rng.randrange(999)}" for _ in range(n))


@pytest.mark.parametrize("exact", [True, False])
def test_many_copies_of_junk_go(spark, exact):
    rng = random.Random(3)
    text = junk(rng)
    rows = [(i, prose(rng), "en", "a") for i in range(260)]
    rows += [(1000 + i, text if exact else f"{text} v{i}", "en", "a") for i in range(140)]  # 35 %
    found = quality.judged(spark.createDataFrame(rows, SHAPE)).where("NOT kept").collect()
    assert {r.doc_id for r in found} == set(range(1000, 1140))


def test_least_determinant(spark):
    rng = np.random.default_rng(4)
    clean, far = rng.normal(0, 1, (300, 6)), rng.normal(0, 0.7, (200, 6)) + 12
    rows = [("g", i, *map(float, x)) for i, x in enumerate([*clean, *far])]
    found = quality.estimates(spark.createDataFrame(rows, ["_group", "_copy", *quality.DIMENSIONS])).collect()
    assert len(found) == 1 and np.abs(found[0].centre).max() < 0.5
    spreads = np.diag(np.linalg.inv(np.array(found[0].inverse).reshape(6, 6)))
    assert 0.4 < spreads.min() and spreads.max() < 2.5


def test_no_group_stays_unjudged(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng), "en", "large") for i in range(150)]
    rows += [(1000 + i, prose(rng) if i < 90 else "short", "de", "a") for i in range(104)]  # 90 sound, 14 failed
    rows += [(2000, junk(rng), "de", "a")]
    rows += [(3000 + i, prose(rng), "fr", f"b{i}") for i in range(5)] + [(4000, junk(rng), None, None)]
    found = {r.doc_id: r for r in quality.judged(spark.createDataFrame(rows, SHAPE)).collect()}
    assert len(found) == len(rows) and all(r.distance is not None for r in found.values())
    assert {d for d, r in found.items() if not r.kept and not r.base_failed} == {2000, 4000}
    few = quality.judged(spark.createDataFrame(rows[200:], SHAPE)).collect()  # 48 sound ones in all
    assert all(r.kept != r.base_failed for r in few)
