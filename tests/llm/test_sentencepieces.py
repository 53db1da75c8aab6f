import random
import struct

import numpy as np
import pyarrow as pa
import pytest

from sieveline.llm import queries
from sieveline.llm import sentencepieces as S

TEXTS = ["", "Hello world", "  two  spaces and\nlines\n", "aaaaaaaaaaaaaaaaaaaaaa", "naïve café 雪雪 😀 end", "x" * 300 + " 000000----", "the the the the", "▁mark", " "]


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def message(pairs):
    out = b""
    for number, value in pairs:
        if isinstance(value, int):
            out += varint(number << 3) + varint(value)
        elif isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


@pytest.fixture(scope="module")
def path():
    return queries.tokenizer("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    """A unigram model of a few pieces."""
    r = random.Random(5)
    spelled = ["<unk>", "▁", *"abc", "ab", "bc", "abc", "aa", "▁a", "ca", "▁ab", "cab"]
    pieces = [(1, message([(1, p.encode()), (2, -0.5 - 3 * r.random()), (3, 2 if p == "<unk>" else 1)])) for p in spelled]
    at = tmp_path_factory.mktemp("model") / "small.model"
    at.write_bytes(message([*pieces, (2, message([(3, 1)])), (3, message([(1, b"identity"), (3, 1), (4, 0)]))]))
    return str(at)


def every(model, text):
    """All segmentations, by cost."""
    if not text:
        return [(0, [])]
    out = []
    for k in range(1, len(text) + 1):
        if text[:k] in model.piece:
            i, cost = model.piece[text[:k]]
            out += [(cost + c, [i, *p]) for c, p in every(model, text[k:])]
    if text[0] not in model.piece:
        out += [(model.dear + c, [model.unknown, *p]) for c, p in every(model, text[1:])]
    return sorted(out)


def test_n_best_equals_all_segmentations(small):
    model, r = S.PieceModel(small, 7), random.Random(1)
    texts = ["".join(r.choice("abc ax") for _ in range(r.randrange(0, 11))) for _ in range(150)]
    for text, found in zip(texts, model.encode(pa.array(texts)), strict=True):
        want = every(model, "▁" + text.replace(" ", "▁") if text else "")
        assert [c for c, _ in found] == [c for c, _ in want[:7]]
        assert len({tuple(p.tolist()) for _, p in found}) == len(found)
        assert all((c, p.tolist()) in want for c, p in found)


def test_n_best_equals_the_library(path):
    """The library's own search, over a unigram model of the same pieces and costs."""
    import sentencepiece

    model, parts, at = S.PieceModel(path), [], 0
    cost = {i: c for i, c in model.piece.values()}
    for number, value in S.fields(open(path, "rb").read()):
        one = dict(S.fields(value))
        if number == 1:
            kind = one.get(3, 1)
            parts.append((1, message([(1, one[1]), (2, -cost[at] / S.UNIT if at in cost else 0.0), (3, kind)])))
            at += 1
        elif number == 2:
            parts.append((2, message([(3, 1), (35, 1), (40, 0), (41, 1), (42, 2)])))
        elif number == 3:
            parts.append((3, value))
    own = sentencepiece.SentencePieceProcessor(model_proto=message(parts))
    for text in ["Hello world", "unbelievable reconstructions of   tokens", "def main(): return 42", "Über die Brücke gehen"]:
        found = next(model.encode(pa.array([text])))
        theirs = own.nbest_encode_as_ids(text, S.N_BEST)
        spell = lambda ids: sum(cost[i] for i in ids)
        assert np.allclose([c / S.UNIT for c, _ in found], [spell(i) / S.UNIT for i in theirs], atol=1e-4)
        assert found[0][1].tolist() == theirs[0]
        assert own.decode(theirs[0]) == model.decode(found[0][1]) == text


def test_round_trip_and_edges(path):
    model = S.PieceModel(path)
    found = list(model.encode(pa.array([*TEXTS, None])))
    for text, f in zip([*TEXTS, ""], found, strict=True):
        costs = [c for c, _ in f]
        assert costs == sorted(costs)
        assert {model.decode(ids) for _, ids in f} == {text.replace("▁", " ")}
        assert len({tuple(ids.tolist()) for _, ids in f}) == len(f)
    assert [len(f) for f in found][0] == 1 and len(found[0][0][1]) == 0
    assert model.decode(np.array([40000, -3])) == "⁇  ⁇ "


def test_frames(spark, path):
    rows = [(i, t, "y") for i, t in enumerate(TEXTS)] + [(None, None, "z"), (1, "Hello world", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    report = S.report(docs, path).collect()
    assert len(report) == len(rows)
    long = S.encoded(docs, path)
    assert long.where("rank = 1").count() == len(rows)
    back = {r.text for r in S.decoded(long, path).collect()}
    assert back == {t.replace("▁", " ") for t in TEXTS}
    assert S.report(docs.limit(0), path).count() == 0 and S.encoded(docs.limit(0), path).count() == 0
    assert S.decoded(spark.createDataFrame([(1, None), (2, [None, 13])], "doc_id long, ids array<int>"), path).where("text = ''").count() == 1


def test_long_lattices_have_the_same_segmentations(monkeypatch):
    model = S.PieceModel(queries.tokenizer("piece_bpe_32k.model"))
    r = random.Random(6)
    texts = ["".join(r.choice("abcdefgh \u2581é雪ß") for _ in range(n)) for n in (1, 2, 9, 60, 700, S.ARCS, S.ARCS + 1)]
    got = [model.segmentations(t) for t in texts]
    for arcs in (0, 10**9):
        monkeypatch.setattr(S, "ARCS", arcs)
        assert [model.segmentations(t) for t in texts] == got
