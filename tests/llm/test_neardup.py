import random
import re

import numpy as np
import pyarrow as pa
import pytest

from sieveline.llm import neardup

SCHEMA = "doc_id long, text string, node string, cluster int"


def shingles(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for g, (i, _) in zip(group, rows, strict=True):
        least[g] = min(least.get(g, i), i)
    return {i: (len(s), least[g], least[g] == i) for (i, _), s, g in zip(rows, sets, group, strict=True)}


def made(seed):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgÀé") for _ in range(r.randrange(2, 7))) for _ in range(300)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    out = []
    for n in (12, 40, 120, 600):
        for _ in range(6):
            base = text(n)
            out.append(" ".join(base))
            for changes in (0, 1, 2, max(1, n // 60), max(2, n // 30)):
                copy = list(base)
                for _ in range(changes):
                    copy[r.randrange(len(copy))] = r.choice(vocabulary)
                out.append(("\n" if changes else " ").join(copy).upper() if r.random() < 0.2 else "  ".join(copy))
    # a chain, each link a little further on
    base = text(100)
    for _ in range(12):
        base = base[2:] + text(2)
        out.append(" ".join(base))
    out += ["", None, " \n ", "one", "ONE", "one two three", "one two  three", "a b c d e", "a b c d e f"]
    r.shuffle(out)
    return [(i * 3 - 50, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 7 if seed == 2 else 2048)
    rows = made(seed)
    docs = spark.createDataFrame([(i, t, "n", 1) for i, t in rows], SCHEMA).repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.components(docs).collect()}
    assert got == brute(rows)


def test_edges(spark):
    docs = spark.createDataFrame([(5, "a b c d e f", "n", 1), (5, "a b c d e f", "n", 1), (9, "A B C D E F", "n", 1), (None, "q r s", "n", 1), (2, None, "n", 1), (1, "", "n", 1)], SCHEMA)
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.components(docs).collect()), key=str)
    assert got == [(1, 1, True), (2, 2, True), (5, 5, True), (5, 5, True), (9, 5, False), (None, None, True)]
    assert neardup.components(docs.limit(0)).count() == 0
    kept = neardup.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == 5 and neardup.deduplicated(docs.limit(0)).count() == 0


def test_long_texts_are_taken_whole():
    text = " ".join(f"w{i}" for i in range(600_000))
    assert len(next(neardup.shingle_sets(pa.array([text])))) == 599_996


def test_pruning_bounds():
    from math import comb

    t = 0.85
    for n in (32, 128):
        m = neardup.least_matches(n)
        posterior = lambda k: sum(comb(n + 1, i) * t**i * (1 - t) ** (n + 1 - i) for i in range(k + 1))  # noqa: B023, E731
        assert posterior(m) >= neardup.MISS > posterior(m - 1)
    sigs = np.stack([neardup.signature(np.arange(1, 5, dtype=np.uint64))] * 2)
    assert (neardup.band_keys(sigs)[0] == neardup.band_keys(sigs)[1]).all() and len(set(neardup.band_keys(sigs)[0])) == neardup.BANDS


@pytest.mark.parametrize(("rows", "tied"), [(1024, 256), (7, 3)])
def test_families_that_their_least_member_does_not_hold_together(spark, monkeypatch, rows, tied):
    """Chains, of which only neighbours are alike; a large family with few outsiders; two
    families that share a band by their beginnings."""
    monkeypatch.setattr(neardup, "BLOCK_ROWS", rows)
    monkeypatch.setattr(neardup, "TIED", tied)
    r = random.Random(8)
    word = lambda: "w%d" % r.randrange(10**9)
    texts = []
    for length in (2, 9, 40):
        words = [word() for _ in range(200)]
        for k in range(length):
            texts.append(" ".join(words))
            words = words[:]
            words[(k * 8) % 192 : (k * 8) % 192 + 8] = [word() for _ in range(8)]
    base = [word() for _ in range(300)]
    for k in range(60):
        own = base[:]
        for i in range(1 + k % 12):
            own[(k * 7 + i * 23) % 300] = word()
        texts.append(" ".join(own))
    texts += [" ".join(base[:260] + [word() for _ in range(12)]), " ".join(base[:200]), " ".join(base[30:])]
    r.shuffle(texts)
    docs = list(enumerate(texts))
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in neardup.components(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute(docs)


def test_rows_that_repeat_very_often_are_looked_at_once(spark):
    text = " ".join("w%d" % i for i in range(80))
    docs = [(1, text)] * 3000 + [(2, text + " x")] + [(3, "other words " * 9)]
    got = neardup.components(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).groupBy("doc_id", "component_id").count().collect()
    assert sorted(map(tuple, got)) == [(1, 1, 3000), (2, 1, 1), (3, 3, 1)]
