import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quality_probe.llm import (
    lm_score, mixing, ngram_join, order_minhash, packing, quality, queries, secrets, sharding, suffix_array,
    suffix_dedup, url_rules,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SHAPE = "doc_id bigint, text string, lang string, source string, n_chars bigint, `window` string, `size` string"


def corpus():
    """Copies, near copies, shared passages, nulls, empty and blank texts, repeated rows, clashing columns."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeéü") for _ in range(rng.randint(2, 8))) for _ in range(300)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    base, passage = prose(200), prose(60)
    texts = [None, "", " \n\t ", "one", "a b c d", "x" * 900, base, base, base + " tail words here", "Ab " * 300]
    texts += [prose(rng.randint(3, 150)) + " " + passage + " " + prose(rng.randint(3, 90)) for _ in range(12)]
    texts += [" ".join(w if rng.random() > 0.01 else "zz" for w in base.split()) for _ in range(8)]
    texts += [prose(3000), 'login token = "9f8a7b6c5d4e3f2a1b0c9d8e7f6a5b4c" end', "password: token:abcdefgh", "AKIA" + "A1" * 9]
    rows = [(i, t, [None, "en", "de"][i % 3], [None, "a", "b", "a", "a"][i % 5], 0, "w", "s") for i, t in enumerate(texts)]
    return [*rows, rows[6], (None, "no id at all", None, "b", 0, "w", "s")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SHAPE).repartition(3, "doc_id").cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SHAPE)


def texts():
    return [(r[0], r[1] or "") for r in corpus()]


def test_join_equals_brute_force(docs):
    sets = {}
    for doc, text in texts():
        w = WORD.findall(text)
        sets.setdefault(doc, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    kinds = list(set(sets.values()))
    near = {s: [t for t in kinds if t is not s and s and t and 5 * len(s & t) >= 4 * len(s | t)] for s in kinds}

    def reached(s):
        seen, todo = {s}, [s]
        while todo:
            for t in near[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return seen

    found = ngram_join.joined(docs).collect()
    assert len(found) == len(corpus())
    for row in found:
        group = reached(sets[row.doc_id])
        ids = [d for d, s in sets.items() if s in group and d is not None]
        assert row.class_id == min(ids, default=None)
        assert row.n_links == len(near[sets[row.doc_id]])
    kept = ngram_join.kept_documents(docs)
    assert kept.columns == docs.columns and kept.count() == len({r.class_id for r in found})


@pytest.mark.parametrize("limit", [4096, 3])
def test_dedup_equals_brute_force(docs, limit):
    raws = [(d, t.encode()) for d, t in texts()]
    seen = Counter(raw[k : k + 200] for _, raw in raws for k in range(len(raw) - 199))
    expected = []
    for doc, raw in raws:
        gone = [False] * len(raw)
        for k in range(len(raw) - 199):
            if seen[raw[k : k + 200]] > 1:
                gone[k : k + 200] = [True] * 200
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        runs = sum(g and not b for g, b in zip(gone, [False, *gone]))
        expected.append((doc, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    found = [tuple(r)[:5] for r in suffix_dedup.deduplicated(docs, limit).collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    assert sum(e[2] for e in expected)


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(2)
    for _ in range(300):
        s = np.repeat(rng.integers(0, rng.integers(1, 5), rng.integers(0, 25)), rng.integers(1, 4))
        plain = s.tolist()
        order = sorted(range(len(plain)), key=lambda i: plain[i:])
        assert suffix_array.suffix_array(s).tolist() == order
        shared = suffix_array.permuted_prefixes(s, np.array(order, np.int64), 9)
        for x, y in zip(order, order[1:]):
            n = next((k for k in range(9) if max(x, y) + k >= len(plain) or plain[x + k] != plain[y + k]), 9)
            assert shared[y] == n


def test_secrets(docs):
    words = secrets.dictionary(queries.tokenizer_path())
    assert secrets.guess_cost("password123", words) < secrets.GUESSES < secrets.guess_cost("9f8a7b6c5d4e3f2a", words)
    assert secrets.guess_cost("qwertyuiop", words) < 8 and secrets.guess_cost("a" * 5000, words) < 6
    found = {r.doc_id: r for r in secrets.scan(docs, queries.tokenizer_path()).collect()}
    by_text = {t: d for d, t in texts()}
    assert found[by_text["password: token:abcdefgh"]].n_assign == 0  # the first match takes the second's name
    assert found[by_text["AKIA" + "A1" * 9]].n_access == 1
    token = found[by_text['login token = "9f8a7b6c5d4e3f2a1b0c9d8e7f6a5b4c" end']]
    assert (token.n_assign, token.n_hex, token.n_guess) == (1, 1, 1)
    clean = secrets.redacted_documents(docs, queries.tokenizer_path())
    assert clean.columns == docs.columns and clean.where("text IS NULL").count() == 1
    assert clean.where("text = 'login [SECRET]\" end'").count() == 1


def test_packing_round_trip(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in packing.packed(docs, queries.tokenizer_path(), length=64).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    copies = Counter(d for d, _ in texts())
    for doc, text in dict(texts()).items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        assert sum(r.length for r in pieces[doc]) == copies[doc] * len(ids)
        for r in pieces[doc]:
            part = np.array(ids[r.start : r.start + r.length], "<u4")
            assert r.ids_crc32 == zlib.crc32(part.tobytes()) and r.doc_tokens == len(ids)
    sizes = {}
    for number, rows in sequences.items():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        sizes[number] = at
    assert sorted(sizes) == list(range(len(sizes)))
    assert all(sizes[n] == 64 for n in range(len(sizes) - 1))


def test_scores_equal_brute_force_and_learn(docs):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tokens = [(d, [*WORD.findall(t.translate(lower)), None]) for d, t in texts()]

    def held(d):
        return zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2

    counts = Counter(w for d, ws in tokens if not held(d) for w in ws)
    n, v = sum(counts.values()), len(counts)
    for frequent in (10, 1000):
        for r in lm_score.scored(docs, frequent).collect():
            ws = dict(tokens)[r.doc_id]
            assert (r.n_tokens, r.n_known) == (len(ws), sum(counts[w] > 0 for w in ws))
            assert r.held_out == held(r.doc_id) and r.train_tokens == n
            assert r.base_score == pytest.approx(sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
            assert r.score < 0


def test_mix_stays_within_a_block(spark, docs):
    rows = [(i, f"s{0 if i < 700 else 1 if i < 900 else 2}") for i in range(1000)]
    many = spark.createDataFrame(rows, "doc_id bigint, source string")
    weights = spark.createDataFrame([("s0", 0.5), ("s1", 0.3), ("s2", 0.2)], "source string, weight double")
    found = sorted(mixing.mix(many, weights, block=1, period=10).collect(), key=lambda r: r.position)
    assert [r.position for r in found] == list(range(1000))
    seen = Counter()
    for t, r in enumerate(found[:400], 1):  # before a source runs out
        seen[r.source] += 1
        assert all(abs(seen[s] - t * w) < 1 for s, w in (("s0", 0.5), ("s1", 0.3), ("s2", 0.2)))
        assert r.release <= r.slot < r.deadline
    assert len({r.position for r in mixing.mix(docs).collect()}) == len(corpus())
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == len(corpus())


def test_fingerprints(docs):
    known = sorted((d, t) for d, t in texts() if d is not None)
    following = {x: known[(i + 1) % len(known)][1] for i, x in enumerate(known)}
    by_text = {}
    for r in order_minhash.fingerprints(docs).collect():
        text = dict(texts())[r.doc_id]
        half = len(text) // 2
        options = {following[x][:half] for x in known if x[0] == r.doc_id} or {""}
        assert r.edited_sha256 in {hashlib.sha256((text[: len(text) - half] + o).encode()).hexdigest() for o in options}
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    base = texts()[6][1]
    swapped = " ".join(base.split()[100:] + base.split()[:100])
    a, b, c = order_minhash.signatures([base, base + " end", swapped])[:, None]
    assert order_minhash.likeness(a, b)[0] > order_minhash.likeness(a, c)[0]


def test_quality(spark, docs):
    for r in quality.judged(docs).collect():
        text = dict(texts())[r.doc_id]
        w = WORD.findall(text)
        triples = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        twice = {i + k for i, x in enumerate(triples) if Counter(triples)[x] > 1 for k in range(3)} if len(w) < 400 else None
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert r.n_words == len(w) and r.word_chars == sum(map(len, w))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", text)) and r.n_dup_lines == len(lines) - len(set(lines))
        if twice is not None:
            assert r.n_repeat_words == len(twice)
            assert r.base_failed == (len(w) < 50 or 100 * len(twice) > 50 * len(w))
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]) + str(rng.randrange(99))
                         for _ in range(80)), "en", "a") for i in range(300)]
    rows += [(1000 + i, "### ".join(f"w{rng.randrange(999)}" for _ in range(80)), "en", "a") for i in range(5)]
    judged = quality.judged(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"))
    assert {r.doc_id for r in judged.where("NOT kept").collect()} == set(range(1000, 1005))


def test_shards(docs):
    found = sharding.shard_rows(docs, 5).collect()
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert sorted(r.row_number for r in found) == list(range(len(corpus())))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(s) for s in slots.values()]
    assert max(sizes) - min(sizes) <= 1


def test_url_rules(spark):
    urls = [None, "", "http://a.example.org/es/1", "HTTPS://X.EXAMPLE.ORG/en/12?q", "http://com/fr/a", "no-scheme/de/",
            "http://spam-farm.test/x", "http://b.net/casino/", "http://b.net/wp-login.php", "http://org", "http://b.net/wp-login.php"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").selectExpr("*", "'h' AS host", "1 AS rule")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(pages).collect()}
    assert found[0] == ("", "", None, "allow") and found[5] == ("", "", None, "allow")
    assert found[2][2:] == ("example.org/es/", "block") and found[3] == ("x.example.org", "/en/12", "example.org/en/1", "block")
    assert found[4][2:] == ("com/fr/", "allow") and found[9] == ("org", "", None, "allow")
    assert [found[i][3] for i in (6, 7, 8, 10)] == ["block"] * 4


def test_empty_tables(spark, empty):
    path = queries.tokenizer_path()
    for frame in (
        ngram_join.joined(empty), suffix_dedup.deduplicated(empty), secrets.scan(empty, path), packing.packed(empty, path),
        lm_score.scored(empty), mixing.mix(empty), order_minhash.fingerprints(empty), quality.judged(empty),
        sharding.shard_rows(empty, 24), url_rules.judge(spark.createDataFrame([], "page_id bigint, url string")),
    ):
        assert frame.count() == 0
