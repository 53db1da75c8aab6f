import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from sieveline.llm import suffixes

FULL = "doc_id long, text string, key string, spans int"


def brute(texts, width=200):
    seen = {}
    for t in texts:
        for i in range(len(t) - width + 1):
            seen[t[i : i + width]] = seen.get(t[i : i + width], 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def made(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij éß雪") for _ in range(r.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, long = text(60), text(500)
    texts = [text(r.randrange(1, 150)) for _ in range(25)]
    texts += [text(30) + passage + text(40), passage, text(20) + passage[3:], passage[:-2] + text(5), passage[:199], passage + passage]
    texts += [long, long[:1500] + "X" + long[1501:], long[700:1400], text(3000)]
    texts += ["a" * 199, "b" * 200, "c" * 201, "d" * 450, "ab" * 150, "xyz" * 100 + "q", "e" * 5000]
    texts += [texts[3], texts[3], "", None, "short", "short"]
    line = text(12) + "\n"
    texts += [line * 40, text(9) + line * 9 + text(9)]
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize(("seed", "hot", "bucket", "common"), [(1, suffixes.HOT, suffixes.BUCKET, suffixes.COMMON), (2, 2, 50, 99), (3, 3, 300, 2), (5, 3, 1, 3), (6, 1, 40, 1)])
def test_equals_brute_force(spark, seed, hot, bucket, common):
    texts = made(seed)
    want = brute([(t or "").encode() for t in texts])
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(texts)], FULL).repartition(5)
    key = "unhex(md5(encode(coalesce(text, ''), 'UTF-8')))"
    cut = suffixes.cut_repeats(docs, hot, bucket, common).drop("kept")
    got = docs.selectExpr("doc_id", f"{key} AS key").join(cut, "key").orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == want


def test_results_and_edges(spark):
    texts = made(4)
    docs = spark.createDataFrame([(i if i else None, t, "k", 1) for i, t in enumerate(texts)], FULL)
    want = sorted(brute([(t or "").encode() for t in texts]))
    got = suffixes.report(docs).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert sum(r.doc_id is None for r in got) == 1
    out = suffixes.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(texts)
    assert suffixes.report(docs.limit(0)).count() == 0 and suffixes.without_repeats(docs.limit(0)).count() == 0
    whole = suffixes.without_repeats(spark.createDataFrame([(1, "z" * 100, "k", 1), (2, "y" * 100, "k", 1)], FULL))
    assert sorted(r.text[0] * len(r.text) for r in whole.collect()) == ["y" * 100, "z" * 100]


def test_windows_met_again_in_a_later_chunk():
    r = random.Random(9)
    text = lambda n: bytes(r.choice(b"abcdefghij ") for _ in range(n))
    shared = text(230)
    texts = [text(900) + shared + text(700), text(800) + shared + text(300) + shared, text(600)]
    data, offsets = suffixes.buffers(pa.array(texts))
    row, at, most, least, _, _ = suffixes.anchors(data, offsets)
    todo = [[{"place": int(a << 16 | m << 8 | x), "act": suffixes.FLOOD} for i, a, m, x in zip(row, at, most, least, strict=True) if i == k] for k in range(len(texts))]
    kind = pa.list_(pa.struct([("place", pa.int64()), ("act", pa.int32())]))
    batch = pa.RecordBatch.from_arrays([pa.array([b"%016d" % k for k in range(len(texts))]), pa.array(texts), pa.array(todo, kind)], ["key", "text", "todo"])
    for chunk in (1, 2, 5, 2000):
        out = pa.Table.from_batches(suffixes._contexts(np.zeros(0, "S48"), 4, chunk)(iter([batch])))
        found = pa.Table.from_batches(suffixes._sorted_buckets()(iter(out.sort_by("bucket").combine_chunks().to_batches()))).to_pylist()
        gone = [bytearray(len(t)) for t in texts]
        for x in found:
            gone[int(x["key"])][x["start"] : x["stop"]] = b"\1" * (x["stop"] - x["start"])
        assert [sum(g) for g in gone] == [n for _, n, _, _ in brute(texts)], chunk


@pytest.mark.parametrize(("hot", "bucket"), [(suffixes.HOT, suffixes.BUCKET), (1, 500), (30, 7)])
def test_thousands_of_anchors_in_a_batch(spark, hot, bucket):
    """Many pairs that share a passage, more anchors than are looked at together, in one batch
    and in several; a passage too short to go stands in every text."""
    r = random.Random(12)
    text = lambda n: "".join(r.choice("abcdefghijklmn ") for _ in range(n))
    common = text(120)
    texts = []
    for _ in range(900):
        shared = text(230)
        texts += [text(20) + shared + text(15) + common, text(9) + common + shared]
    want = brute([t.encode() for t in texts])
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(texts)], FULL)
    for parts in (1, 6):
        got = suffixes.report(docs.repartition(parts), hot, bucket).orderBy("doc_id").collect()
        assert [(x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got] == want


@pytest.mark.parametrize("kinds", [2, 5, 10**6])
def test_multikey_quicksort(kinds):
    r = np.random.default_rng(5)
    for n in (0, 1, 2, suffixes.SMALL + 1, 3000):
        words, groups = r.integers(0, kinds, (n, 6)).astype(np.uint64), r.integers(0, 3, n)
        words[: n // 2] = words[:1] if n else words[:0]
        order = suffixes.multikey_sort(words, groups)
        rows = [(int(g), *w) for g, w in zip(groups, words.tolist(), strict=True)]
        assert sorted(order.tolist()) == list(range(n)) and [rows[i] for i in order] == sorted(rows)


def test_any_other_column_is_carried_along(spark):
    text = "".join(map(str, range(150)))
    row = (1, text, 5, 6, 7, 8, "x")
    docs = spark.createDataFrame([row, (2, text[:150] + "?", 5, 6, 7, 8, None)], "doc_id long, text string, kept int, _key int, key int, row int, n string")
    got = suffixes.without_repeats(docs).orderBy("doc_id").collect()
    assert [tuple(x) for x in got] == [row, (2, text[:150] + "?", 5, 6, 7, 8, None)]
