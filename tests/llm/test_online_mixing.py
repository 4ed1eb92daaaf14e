import math

import numpy as np

from quality_probe.llm import lm_score as L


def model():
    rng = np.random.default_rng(3)
    keys = np.sort(rng.integers(1, 1 << 60, 40))
    code = L.Code({s: int(n) for s, n in enumerate(rng.integers(0, 50, 256))}, 9, keys, rng.integers(1, 90, 40), 4000)
    table = rng.normal(0, 2, (L.PREDICTORS, 1 << L.SLOT_BITS)).astype(np.float32)
    return code, np.clip(table, -L.CLIP, L.CLIP)


def sequences(sizes):
    rng = np.random.default_rng(4)
    symbols = rng.integers(0, L.FIRST_WORD + 40, sum(sizes)).astype(np.int32)
    own = np.append(0, np.cumsum(sizes))
    return symbols, own, L.contexts_of(symbols, own)


def plain(bits, places, slots, code, table):
    """Bits of one text, one bit after the other."""
    weights = [[L.START] * L.PREDICTORS + [0.0] for _ in range(L.GATES)]
    total, depth = 0.0, code.kind & (L.DEPTHS - 1)
    for e, bit in enumerate(bits):
        x = [float(table[k][slot[e]]) for k, slot in enumerate(slots)] + [L.BIAS]
        own = weights[int(depth[places[e]]) + L.DEPTHS * (abs(x[1]) > L.CONFIDENT)]
        one = 1 / (1 + math.exp(-sum(a * b for a, b in zip(own, x, strict=True))))
        total -= math.log2(one if bit else 1 - one)
        for i, value in enumerate(x):
            own[i] += L.RATE * (int(bit) - one) * value
    return total


def test_weights_learn_from_every_bit():
    code, table = model()
    symbols, own, contexts = sequences([300, 1, 40, 7, 900])
    found = L.text_bits(symbols, own, contexts, code, table)
    for at, to, bits in zip(own[:-1], own[1:], found, strict=True):
        made = L.events(code, symbols[at:to], [c[at:to] for c in contexts])[:3]
        assert math.isclose(bits, plain(*made, code, table), rel_tol=1e-4)


def test_a_text_scores_alike_alone_and_in_any_window(monkeypatch):
    code, table = model()
    symbols, own, contexts = sequences([300, 1, 40, 7, 900])
    together = L.text_bits(symbols, own, contexts, code, table)
    for i, (at, to) in enumerate(zip(own[:-1], own[1:], strict=True)):
        alone = L.text_bits(symbols[at:to], np.array([0, to - at]), [c[at:to] for c in contexts], code, table)
        assert math.isclose(alone[0], together[i], rel_tol=1e-6)
    monkeypatch.setattr(L, "LEAST_STEPS", 5)
    monkeypatch.setattr(L, "EVENTS", 5)
    assert np.allclose(L.text_bits(symbols, own, contexts, code, table), together, rtol=1e-6)
    assert len(L.text_bits(symbols[:0], np.array([0]), [c[:0] for c in contexts], code, table)) == 0
