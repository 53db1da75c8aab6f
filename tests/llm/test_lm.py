import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sieveline.llm import lm

SCHEMA = "doc_id long, text string, score string, train string, block long"


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["\0end"]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def made(n=120):
    r = random.Random(4)
    words = ["".join(r.choice("abcdÀé") for _ in range(r.randrange(1, 5))) for _ in range(150)]
    rows = []
    for i in range(n):
        at, out = r.randrange(150), []
        for _ in range(r.randrange(0, 60)):
            at = (at * 7 + r.randrange(4)) % 150
            out.append(words[at] if r.random() < 0.9 else words[at].upper())
        rows.append((i, r.choice([" ", "\n", "  "]).join(out)))
    return rows + [(500, None), (501, ""), (502, " \t"), (503, rows[3][1]), (504, rows[3][1]), (505, "wholly unseen words")]


class Plain:
    """The model as a dictionary of all n-grams, which is asked by recursion."""

    def __init__(self, texts, strengths, order):
        self.order, self.strengths, self.counts = order, strengths, Counter()
        for t in texts:
            path = [None, *t]
            for k in range(1, order + 1):
                self.counts.update(tuple(path[i : i + k]) for i in range(len(path) - k + 1) if path[i + k - 1] is not None)
        self.counts[(None,)] = len(texts)
        one = [c for g, c in self.counts.items() if len(g) == 1 and g[0] is not None]
        self.total, self.floor = sum(one), sum(one) + len(one) + 1

    def chance(self, history, w, less=0):
        if not history:
            return (self.counts[(w,)] - less + 1) / (self.floor - less)
        lower = self.chance(history[1:], w, less)
        if not self.counts[history]:
            return lower
        k = self.strengths[len(history) - 1]
        return (self.counts[(*history, w)] - less + k * lower) / (self.counts[history] - less + k)

    def score(self, t, less=0):
        path = [None, *t]
        return sum(math.log10(self.chance(tuple(path[max(0, i - self.order + 1) : i]), path[i], less)) for i in range(1, len(path)))


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_the_plain_model_is_a_distribution(order):
    texts = [tokens(t) for _, t in made(30)]
    model = Plain(texts, (4.0, 8.0, 2.0), order)
    vocabulary = {w for t in texts for w in t}
    for history in ((None,), (None, texts[3][0]), tuple(texts[5][:3]), ("unseen",)):
        total = sum(model.chance(history[-(order - 1) :] if order > 1 else (), w) for w in vocabulary)
        assert abs(total + model.chance(history[-(order - 1) :] if order > 1 else (), "never") - 1) < 1e-9


@pytest.mark.parametrize(("order", "block"), [(1, 900), (2, 16 << 20), (2, 700), (3, 16 << 20), (3, 700), (4, 900)])
def test_equals_the_plain_model(spark, order, block):
    rows = made()
    docs = spark.createDataFrame([(i, t, "s", "t", 1) for i, t in rows], SCHEMA).repartition(4)
    got = {r.doc_id: r for r in lm.scores(docs, order=order, block_bytes=block, shard_entries=200).collect()}
    train = [tokens(t) for i, t in rows if not held(i)]
    counts = Counter(w for t in train for w in t)
    total = sum(counts.values())
    chosen = ()
    for k in range(2, order + 1):  # each order's strength is the likeliest, one left out
        chosen += (max(lm.STRENGTHS, key=lambda s: sum(Plain(train, (*chosen, s), k).score(t, 1) for t in train)),)  # noqa: B023
    assert tuple(got[0].strengths) == chosen
    model = Plain(train, chosen, order)
    for i, t in rows:
        own, x = tokens(t), got[i]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held(i), len(own), sum(counts[w] > 0 for w in own), total)
        assert math.isclose(x.base_score, sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in own), rel_tol=1e-9)
        assert math.isclose(x.score, model.score(own), rel_tol=1e-9)


@pytest.mark.parametrize(("order", "lane"), [(2, 1), (3, 1), (3, 7), (4, 2), (3, 10_000)])
def test_lanes_carry_the_state_of_the_automaton(order, lane):
    """States, arcs and failure arcs, walked one token at a time, against lanes."""
    rows = made(40)
    texts = [t or "" for _, t in rows]
    paths = lm.Paths(pa.table({"text": texts, "train": [i is not None and i % 3 > 0 for i, _ in rows]}), order)
    train = sum(i % 3 > 0 for i, _ in rows)
    floor = int(paths.counts[1].sum()) + int((paths.counts[1] > 0).sum()) + 1
    own = lm.Automaton(paths, order, (8.0, 4.0)[: order - 2], (2.0, 32.0), floor, train)
    got = lm.traverse(paths, own, lane)
    for i in range(len(rows)):
        state, total = own.start, np.zeros(2)
        for j in range(paths.bounds[i], paths.bounds[i + 1]):
            d = int(own.depth[state])
            while d and not paths.counts[d + 1][paths.of[d + 1][j]]:
                total += own.fail_last[state] if d + 1 == order else own.fail[state]
                state = own.fail_to[state]
                assert own.depth[state] == d - 1
                d -= 1
            gram = paths.of[d + 1][j]
            known = paths.counts[d + 1][gram] > 0
            total += own.arc[d + 1][gram] if known else own.unknown
            state = own.arc_to[d + 1][gram] if known else 0
        assert np.allclose(got[i], total, rtol=1e-12)


def test_held_out_texts_gain(spark):
    rows = made(400)
    docs = spark.createDataFrame([(i, t, "s", "t", 1) for i, t in rows], SCHEMA)
    some = [r for r in lm.scores(docs).collect() if r.held_out]
    assert len(some) > 20 and sum(r.score for r in some) > sum(r.base_score for r in some) + 20


def test_edges(spark):
    docs = spark.createDataFrame([(None, None, "s", "t", 1), (None, "a", "s", "t", 1), (1, "a b", "s", "t", 1), (1, "a b", "s", "t", 1)], SCHEMA)
    got = lm.scores(docs).collect()
    assert len(got) == 4 and sum(r.n_tokens for r in got) == 9 and all(not r.held_out for r in got if r.doc_id is None)
    assert lm.scores(docs.limit(0)).count() == 0
    only = spark.createDataFrame([(next(i for i in range(99) if held(i)), "a b", "s", "t", 1)], SCHEMA)
    x = lm.scores(only).first()
    assert (x.train_tokens, x.n_known) == (0, 0) and x.base_score == x.score == 0.0
