import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sieveline.llm import quality

SCHEMA = "doc_id long, text string, score string, y int, lang string"


def made(n=400):
    r = random.Random(7)
    good, bad = ["The %s of %s was known." % (a, b) for a in "river stone garden light".split() for b in "winter morning Rome".split()], ["CLICK here %s!!!", "win $$$ %s now", "free free %s"]
    docs, labels = [], []
    for i in range(n):
        y = int(r.random() < 0.6)
        docs.append((i, " ".join(r.choice(good) if y else r.choice(bad) % r.randrange(99) for _ in range(r.randrange(2, 12)))))
        if i % 3:
            labels.append((i, y))
    truth = {i: int("was known" in t) for i, t in docs}
    return docs, labels, truth


def test_held_out_accuracy(spark):
    docs, labels, truth = made()
    d = spark.createDataFrame([(i, t, "s", 9, "x") for i, t in docs], SCHEMA)
    l = spark.createDataFrame([(i, y, 0) for i, y in labels], "doc_id long, quality int, toxic int")  # noqa: E741
    got = quality.report(d, l).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    # labels of held-out rows are not learnt from, nor the other columns
    other = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y, 1) for i, y in labels], "doc_id long, quality int, toxic int")
    again = quality.report(d.withColumn("lang", d.doc_id.cast("string")), other).collect()
    assert {(r.doc_id, round(r.score, 9)) for r in again} == {(r.doc_id, round(r.score, 9)) for r in got}
    kept = quality.accepted(d, l)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted}


def test_driver_table(spark):
    """On the driver's own labels, of which a quarter is held out."""
    top = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{top}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.report(docs, labels).join(labels, "doc_id").where("held_out AND quality IS NOT NULL").select("quality", "predicted").collect()
    assert len(rows) > 20 and np.mean([r.quality == r.predicted for r in rows]) > 0.9


def test_dual_coordinate_descent_meets_its_conditions():
    r = np.random.default_rng(2)
    rows = [np.unique(r.integers(0, 40, 9)) for _ in range(80)]
    labels = np.where(r.random(80) < 0.5, 1, -1)
    scale, costs = r.normal(1, 0.3, 40), np.full(80, 0.8)
    w = quality.descend(rows, labels, scale, costs, epochs=3000)
    values = [scale[x] / np.linalg.norm(scale[x]) for x in rows]

    def objective(v):
        return v @ v / 2 + sum(c * max(0, 1 - y * (v[x] @ z)) for x, z, y, c in zip(rows, values, labels, costs, strict=True))

    best = objective(w)
    assert all(objective(w + r.normal(0, s, 40)) > best - 1e-3 for s in (1e-3, 1e-2, 0.1) for _ in range(60))


def test_ratios():
    rows = [np.array([1, 2]), np.array([1]), np.array([3])]
    ratio = quality._ratios(rows, np.array([1, 1, -1]))
    size = 1 << quality.BITS
    assert np.isclose(ratio[1], np.log((3 / (size + 3)) / (1 / (size + 1)))) and ratio[3] < 0


@pytest.mark.parametrize("marks", [[], [(1, 1)], [(1, 1), (2, 1)], [(None, 1), (1, None)], [(1, 0), (1, 1), (2, 0)]])
def test_edges(spark, marks):
    d = spark.createDataFrame([(1, "good text", "s", 1, "x"), (2, "", "s", 1, "x"), (2, None, "s", 1, "x"), (None, "q " * 50_000, "s", 1, "x")], SCHEMA)
    l = spark.createDataFrame(marks, "doc_id long, quality int")  # noqa: E741
    got = quality.report(d, l).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert quality.report(d.limit(0), l).count() == 0 and quality.accepted(d.limit(0), l).count() == 0


def test_features_are_of_whole_texts():
    a, b = "w " * 3_000_000, "w " * 3_000_000 + "last"
    sets = [found[s:e] for bound, found in quality.features(pa.array([a, b])) for s, e in zip(bound[:-1], bound[1:], strict=True)]
    assert len(sets[1]) > len(sets[0])


def test_the_model_equals_a_plain_one():
    """Log-count ratios, dual coordinate descent, margins and the curve, with loops and
    dictionaries, on the same indicators and in the same order of rows."""
    import math
    import random

    r = random.Random(21)
    good, bad = ["w%d" % i for i in range(30)], ["w%d" % i for i in range(20, 50)]
    texts = [" ".join(r.choice(good if i % 3 else bad) for _ in range(r.randrange(1, 25))) for i in range(90)]
    labels = np.array([1 if i % 3 else -1 for i in range(90)])
    rows = [f[a:b] for bound, f in quality.features(pa.array(texts)) for a, b in zip(bound[:-1], bound[1:], strict=True)]

    def fit(rows, labels):
        counts = {y: {} for y in (1, -1)}
        for row, y in zip(rows, labels, strict=True):
            for f in row.tolist():
                counts[y][f] = counts[y].get(f, 0) + 1
        size = {y: quality.SMOOTH * 2**quality.BITS + sum(c.values()) for y, c in counts.items()}
        ratio = lambda f: math.log((counts[1].get(f, 0) + quality.SMOOTH) / size[1]) - math.log((counts[-1].get(f, 0) + quality.SMOOTH) / size[-1])
        xs = []
        for row in rows:
            x = {f: ratio(f) for f in row.tolist()}
            norm = max(math.sqrt(sum(v * v for v in x.values())), 1e-12)
            xs.append({f: v / norm for f, v in x.items()})
        share = {y: quality.COST * 0.5 / max(sum(z == y for z in labels), 1) * len(labels) for y in (1, -1)}
        w, alpha, order = {}, [0.0] * len(rows), np.random.default_rng(1)
        for _ in range(quality.EPOCHS):
            moved = 0.0
            for i in order.permutation(len(rows)).tolist():
                y = int(labels[i])
                if not xs[i]:
                    continue
                slope = y * sum(w.get(f, 0.0) * v for f, v in xs[i].items()) - 1
                new = min(max(alpha[i] - slope, 0.0), share[y])
                for f, v in xs[i].items():
                    w[f] = w.get(f, 0.0) + (new - alpha[i]) * y * v
                moved, alpha[i] = max(moved, abs(new - alpha[i])), new
            if moved < 1e-3:
                break
        return w, ratio

    def margin(row, w, ratio):
        x = [(f, ratio(f)) for f in row.tolist()]
        return sum(w.get(f, 0.0) * v for f, v in x) / max(math.sqrt(sum(v * v for _, v in x)), 1e-12) if x else 0.0

    model, (w, ratio) = quality.Model(rows, labels), fit(rows, labels)
    held = [0.0] * 90
    for fold in (0, 1):
        own = fit([x for i, x in enumerate(rows) if i % 2 != fold], [y for i, y in enumerate(labels) if i % 2 != fold])
        for i in range(fold, 90, 2):
            held[i] = margin(rows[i], *own)
    slope, shift = quality._curve(np.array(held), labels)
    scores = model.score(pa.array(texts))
    for row, score in zip(rows, scores, strict=True):
        assert abs(score - 1 / (1 + math.exp(-(slope * margin(row, w, ratio) + shift)))) < 1e-3


def test_the_model_is_fitted_in_a_task(spark, monkeypatch):
    """The driver, whose memory doesn't grow with rows and texts, fits nothing and gets the model alone."""
    docs, labels, _ = made()
    docs = [(i, t + " ") for i, t in docs]
    texts = dict(docs)
    own = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 4 != 2]
    rows = [f[a:b] for bound, f in quality.features(pa.array([texts[i] for i, _ in own])) for a, b in zip(bound[:-1], bound[1:], strict=True)]
    want = quality.Model(rows, np.array([1 if y else -1 for _, y in own]))

    def here(*_):
        raise AssertionError("fitted on the driver")

    monkeypatch.setattr(quality, "_fit", here)
    got = quality.fit(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(labels, "doc_id long, quality int"))
    assert np.allclose(got.gain, want.gain, rtol=1e-5, atol=1e-6) and np.allclose(got.square, want.square, rtol=1e-5)
    assert got.slope == pytest.approx(want.slope) and got.shift == pytest.approx(want.shift)
