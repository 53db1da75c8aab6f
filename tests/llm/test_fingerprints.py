import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sieveline.llm import fingerprints as P

SCHEMA = "doc_id long, text string, bucket int, own int"


def weights(text, width=5):
    w = text.lower().split()
    return Counter(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else Counter([tuple(w)] if w else [])


def likeness(a, b):
    """Generalised Jaccard similarity."""
    a, b = weights(a), weights(b)
    return sum(min(a[t], b[t]) for t in a) / max(1, sum(max(a[t], b[t]) for t in a.keys() | b.keys()))


def test_collisions_follow_generalised_jaccard():
    r = random.Random(8)
    words = ["w%d" % i for i in range(500)]
    pairs = []
    for share in (0.1, 0.3, 0.5, 0.7, 0.9):
        for _ in range(12):
            parts = [" ".join(r.choice(words) for _ in range(8)) for _ in range(20)]
            base = [r.choice(parts) for _ in range(60)]
            other = [p if r.random() < share else r.choice(parts) for p in base]
            pairs.append((" ".join(base), " ".join(other)))
    got, want = [], []
    for a, b in pairs:
        x, y = P.fingerprints(pa.array([a, b]))
        got.append((x == y).mean())
        want.append(likeness(a, b))
    error = np.array(got) - np.array(want)
    assert abs(error.mean()) < 0.015 and np.sqrt((error**2).mean()) < 0.075  # sd at most 1/16


def test_draws_are_gamma():
    q = P._gamma2(np.array([0.1, 0.5, 0.9]))
    assert np.allclose(1 - (1 + q) * np.exp(-q), [0.1, 0.5, 0.9])
    assert abs(P._R.mean() - 2) < 0.01 and abs(np.exp(P._LOG_C.astype(float)).mean() - 2) < 0.01 and abs(P._B.mean() - 0.5) < 0.01


def test_sampling_is_consistent():
    """A term of a greater weight keeps the sample unless its own value changes."""
    one = np.array([12345], np.uint64)
    pairs = [int(P._sample(one, np.array([w]), 3)[0] & np.uint64(0xFFFFFFFF)) for w in range(2, 400)]
    assert 1 < len(set(pairs)) < 30 and all(pairs.index(p) + pairs.count(p) == len(pairs) - pairs[::-1].index(p) for p in set(pairs))


@pytest.mark.parametrize("parts", [1, 4, 70])
def test_report(spark, parts):
    r = random.Random(2)
    texts = {i * 7 - 50: " ".join(r.choice("ab cde fgh ij é 😀 klm".split(" ")) for _ in range(r.randrange(0, 80))) for i in range(60)}
    texts[1000] = texts[6] = texts[13] = "one two three four five six seven"
    texts[900], texts[901], texts[902] = "", None, "x" * 9
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    rows = P.report(spark.createDataFrame([(i, t, 5, 6) for i, t in texts.items()], SCHEMA).repartition(3)).collect()
    spark.conf.set("spark.sql.shuffle.partitions", old)
    got = {x.doc_id: x for x in rows}
    ids = sorted(texts)
    assert len(rows) == len(ids)
    for i, j in zip(ids, [*ids[1:], ids[0]], strict=True):
        text, after = texts[i] or "", texts[j] or ""
        k = len(text) // 4
        new = text[: len(text) - k] + after[:k]
        own, changed, following = P.fingerprints(pa.array([text, new, after]))
        x = got[i]
        assert (x.n_chars, x.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert (x.fingerprint, x.edited_fingerprint) == tuple(P.spelled([own, changed]))
        assert (x.near_edited, x.near_next) == ((own == changed).mean(), (own == following).mean())
    assert got[6].fingerprint == got[13].fingerprint == got[1000].fingerprint != got[902].fingerprint
    assert got[900].near_next == 1.0


def test_edges(spark):
    one = spark.createDataFrame([(3, "a b c d e f", 1, 1)], SCHEMA)
    assert [x.near_next for x in P.report(one).collect()] == [1.0]
    assert P.report(one.limit(0)).count() == 0
    twice = spark.createDataFrame([(None, None, 1, 1), (None, "q", 1, 1), (3, "a b", 1, 1), (3, "a b", 1, 1), (3, "c", 1, 1)], SCHEMA)
    assert sorted(str(x.doc_id) for x in P.report(twice).collect()) == ["3", "3", "3", "None", "None"]


def plain_print(text):
    """The definition, term by term and sample by sample, in Python's numbers; draws and hashes
    of a term are those of the text that is that term alone."""
    words, out = text.lower().split(), []
    shingles = Counter(" ".join(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else Counter([" ".join(words)] if words else [])
    for k in range(P.SAMPLES):
        best = None
        for s, weight in shingles.items():
            term = int(P.terms(pa.array([s]))[1][0])
            x = ((term ^ int(P._XOR[k])) * int(P._MUL[k])) % 2**64
            x ^= x >> 29
            at, c = (x >> 32) & 65535, x >> 48
            r, b = float(P._R[at]), float(P._B[at])
            t = int(np.floor(np.log(weight) / r + b))
            value = float(P._LOG_C[c]) - r * (t - b + 1)
            pair = (x * 0x9E3779B97F4A7C15) % 2**64
            if t:
                pair = int(P.splitmix(np.array([(pair + t) % 2**64], np.uint64))[0])
            if best is None or value < best[0]:
                best = (value, pair)
        out.append(best[1] >> 32 & 65535 if best else 0)
    return out


def test_prints_equal_the_definition():
    r = random.Random(11)
    texts = ["", "one", "one two three", " ".join(["a b"] * 40)] + [" ".join(r.choice("ab cd ef gh ij".split()) for _ in range(n)) for n in (5, 30, 90)]
    texts += [" ".join("w%d" % r.randrange(60) for _ in range(120))]
    for text, got in zip(texts, P.fingerprints(pa.array(texts)), strict=True):
        same = sum(a == b for a, b in zip(plain_print(text), got.tolist(), strict=True))
        assert same >= P.SAMPLES - 1, "values that are equal but for rounding may go either way"
