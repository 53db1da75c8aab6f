import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sieveline.llm import bpe, packing, queries

SCHEMA = "doc_id long, text string, start string, length string"
TEXTS = [
    "Hello world", "it's  we're they'll I'd 's'll ''t", "  lead\n\n trail  \n", "a b　c 123abc456", "naïve café 雪雪 😀", "x" * 3000, "<|endoftext|>", "", "\t\n", "don't_stop 'round", "͸ odd \U000e0100", "A" * 40 + "'s", "हिन्दी क्षेत्र",
    "'\n's 'S '", "٣٤ ½ ²",
]


@pytest.fixture(scope="module")
def path():
    return queries.tokenizer("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def many():
    r = random.Random(9)
    signs = "abc XYZ 12'\n\t.,é雪😀 _-"
    return TEXTS + ["".join(r.choice(signs) for _ in range(r.randrange(0, 90))) for _ in range(400)]


def test_ids_equal_the_library(path, library):
    texts = many()
    for text, ids in zip(texts, bpe.Encoder(path).encode(pa.array(texts)), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_packing_is_balanced_and_full():
    r = np.random.default_rng(3)
    lengths = r.integers(1, 1024, 700)
    pieces, n = packing.pack(lengths)
    used = defaultdict(list)
    for i, start, m, s, offset in pieces:
        used[s].append((offset, m))
        assert 0 <= start and start + m <= lengths[i]
    assert len(used) == n
    for parts in used.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *(m for _, m in parts)])[:-1].tolist()
    sizes = sorted(sum(m for _, m in parts) for parts in used.values())
    assert sum(sizes) == lengths.sum() and sum(s < 1024 for s in sizes) == bin(int(lengths.sum()) % 1024).count("1")
    covered = defaultdict(list)
    for i, start, m, *_ in pieces:
        covered[i].append((start, m))
    assert all(sum(m for _, m in c) == lengths[i] and len({s for s, _ in c}) == len(c) for i, c in covered.items())
    assert packing.pack(np.zeros(0, np.int64)) == ([], 0)
    costs = [sum(m + m * m / 2048 for _, m in parts) for parts in used.values() if sum(m for _, m in parts) == 1024]
    assert np.std(costs) / np.mean(costs) < 0.15


def test_table(spark, path, library):
    texts = many()[:200] + ["word " * 5000, "word " * 5000]
    rows = [(i, t, "a", "b") for i, t in enumerate(texts)] + [(999, None, "a", "b")]
    got = packing.packed(spark.createDataFrame(rows, SCHEMA).repartition(3), path).collect()
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t, *_ in rows}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        own = ids[r.doc_id]
        part = np.array(own[r.start : r.start + r.length], "<u4")
        assert r.length == len(part) > 0 and r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(part.tobytes())
        by_doc[r.doc_id].append((r.start, r.length))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(ids)
    for whole, tables in ((lambda k: len(ids[k]), by_doc), (lambda k: None, by_sequence)):
        for k, parts in tables.items():
            at = 0
            for first, n in sorted(parts):
                assert first == at
                at += n
            assert at <= 1024 if whole(k) is None else at == whole(k)
    padded = sum(n if (n := sum(m for _, m in p)) & (n - 1) == 0 else 1024 for p in by_sequence.values())
    assert padded == sum(map(len, ids.values()))


def test_edges(spark, path):
    rows = spark.createDataFrame([(None, None, "a", "b"), (1, "", "a", "b"), (1, "", "a", "b")], SCHEMA)
    got = packing.packed(rows.coalesce(1), path).collect()
    assert len(got) == 3 and all((r.start, r.length, r.doc_tokens, r.ids_crc32) == (0, 1, 1, zlib.crc32(bytes(4))) for r in got)
    assert packing.packed(rows.limit(0), path).count() == 0


def plain_pack(lengths, length, quadratic):
    """The same by a search through all sequences for each piece."""
    total = sum(lengths)
    rooms = [length] * (total // length)
    rest, size = total % length, length
    while size:
        if rest & size:
            rooms.append(size)
        size //= 2
    left, cost, out = list(rooms), [0.0] * len(rooms), []

    def put(i, start, n, s):
        out.append((i, start, n, s, rooms[s] - left[s]))
        left[s] -= n
        cost[s] += n + quadratic * n * n

    late = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [s for s in range(len(rooms)) if left[s] >= lengths[i]]
        if fits:
            put(i, 0, lengths[i], min(fits, key=lambda s: (cost[s], s)))
        else:
            late.append(i)
    for i in late:
        start = 0
        while start < lengths[i]:
            s = min((s for s in range(len(rooms)) if left[s]), key=lambda s: (cost[s], s))
            n = min(lengths[i] - start, left[s])
            put(i, start, n, s)
            start += n
    return out, len(rooms)


@pytest.mark.parametrize(("seed", "n", "most", "length"), [(1, 300, 1023, 1024), (2, 50, 63, 64), (3, 400, 20, 64), (4, 1, 5, 8), (5, 0, 5, 8), (6, 200, 64, 64)])
def test_packing_equals_a_plain_search(seed, n, most, length):
    lengths = np.random.default_rng(seed).integers(1, most + 1, n)
    got, count = packing.pack(lengths, length)
    want, rooms = plain_pack(lengths.tolist(), length, packing.QUADRATIC)
    assert [tuple(map(int, x)) for x in got] == want and count == rooms
