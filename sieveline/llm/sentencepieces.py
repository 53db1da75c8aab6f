"""SentencePiece encoding and decoding with N-best segmentation.

A text, led by a space mark, is a lattice of the vocabulary's pieces. Forward Viterbi
scores give every position the cost of its best prefix; they are exact heuristics for a
backward A-star search from the end, which so pops the N best segmentations in order. As
every open hypothesis ends in a path of just its estimate, no more than N need be open.

Between two characters that stand next to each other in no piece every segmentation is
cut, so a lattice is a chain of short ones. Each distinct one is searched once and kept in
a bounded cache; the N best of a text are the N cheapest choices of their alternatives, of
which no more than the N - 1 cheapest second choices can be needed.

Costs are negative log-probabilities in units of 2**-20, as whole numbers, so that sums
are exact. A unigram model's are its own; other models hold ranks of merges, of which the
cost is the logarithm of the rank (Zipf's law). Characters without a piece cost the
largest cost and 10 more, and become their bytes. Equal costs come in a fixed order.

Cases: a null or empty text has one segmentation, of no pieces; a text with fewer than N
segmentations gives all of them; rows are encoded one by one, so repeated rows, ties and
null ids change nothing; an empty table gives no rows; texts are taken whole, and one without
any cut needs memory of its own, about 0.1 KB a character; other columns are left out. Decoding gives the text back, but for U+2581, which is a space to the model;
unknown ids are marked by U+2047, null ids are passed over, and a null list decodes to an
empty text.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from array import array
from bisect import insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, hash_spans, lean, pieces

N_BEST, UNIT, PENALTY, ARCS = 5, 1 << 20, 10, 4096
SPACE = "▁"
#: Fixed values of the model file's format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
UNIGRAM = 1
_CACHED = 800_000
_MODELS: dict[tuple, "PieceModel"] = {}


def fields(data: bytes):
    """Numbers and values of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}[key & 7] if key & 7 != 2 else varint()
            yield key >> 3, data[at : at + size]
            at += size


class PieceModel:
    """The lattice of a model file's pieces; n: how many segmentations are kept."""

    def __init__(self, path: str, n: int = N_BEST):
        spelled, scores, kinds, kind_of_model = [], [], [], UNIGRAM
        for number, value in fields(open(path, "rb").read()):
            if number == 1:
                piece = dict(fields(value))
                spelled.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece.get(2, bytes(4)))[0])
                kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                kind_of_model = dict(fields(value)).get(3, UNIGRAM)
            elif number == 3:
                spec = dict(fields(value))
                if spec.get(2) or spec.get(4, 1) or not spec.get(3, 1):
                    raise ValueError("models that normalise texts are not supported")
        self.n = n
        self.unknown = kinds.index(UNKNOWN) if UNKNOWN in kinds else 0
        self.of_byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(spelled, kinds, strict=True)) if k == BYTE}
        plain = [i for i, k in enumerate(kinds) if k in (NORMAL, USER_DEFINED)]
        if kind_of_model == UNIGRAM:
            cost = {i: round(-scores[i] * UNIT) for i in plain}
        else:
            rank = {i: r for r, i in enumerate(sorted(plain, key=lambda i: (-scores[i], i)), 1)}
            cost = {i: round(float(np.log(r)) * UNIT) for i, r in rank.items()}
        self.piece = {spelled[i]: (i, cost[i]) for i in plain}
        self.table = {p[:k]: () for p in self.piece for k in range(1, len(p))} | self.piece  # () for what only begins pieces
        self.tails = {p[k:]: () for p in self.piece for k in range(1, len(p))} | self.piece  # and only ends them
        self.longest = max(map(len, self.piece), default=1)
        self.dear = max(cost.values(), default=0) + PENALTY * UNIT
        joined = {(ord(a) << 21) | ord(b) for p in self.piece for a, b in zip(p, p[1:])}  # noqa: B905
        self.joined = np.array(sorted(joined), np.int64)
        self.ascii = np.isin((np.arange(128)[:, None] << 21) | np.arange(128), self.joined)
        raw = []
        for p, k in zip(spelled, kinds, strict=True):
            raw.append(bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else b" \xe2\x81\x87 " if k == UNKNOWN else p.replace(SPACE, " ").encode())
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.array([len(x) for x in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size
        self.clear()

    def clear(self) -> None:
        self.slot: dict[int, int] = {}
        # by slot and rank: cost (-1: there is none), number of ids, and where in flat
        self.cost, self.size, self.at = (np.zeros((1 << 15, self.n), t) for t in (np.int64, np.int32, np.int64))
        self.flat, self.used = np.zeros(1 << 18, np.int32), 0

    def _lattice(self, text: str):
        """The arcs that end at a place, in order: cost through the arc, its cost, piece and
        start; and the cost of the best path."""
        n = len(text)
        get, longest, dear = self.table.get, self.longest, self.dear
        best = [0] + [dear * (n + 1)] * n
        arcs: list[list] = [[] for _ in range(n + 1)]
        for i in range(n):
            here = best[i]
            for j in range(i + 1, min(n, i + longest) + 1):
                hit = get(text[i:j])
                if hit is None:
                    break
                if hit:
                    cost = here + hit[1]
                    arcs[j].append((cost, hit[1], hit[0], i))
                    if cost < best[j]:
                        best[j] = cost
            if not get(text[i]):
                cost = here + dear
                arcs[i + 1].append((cost, dear, -1 - ord(text[i]), i))
                if cost < best[i + 1]:
                    best[i + 1] = cost
        for at in arcs:
            if len(at) > 1:
                at.sort()
        return arcs.__getitem__, best[n]

    def _long_lattice(self, text: str):
        """The same for a long text, whose arcs would take half a kilobyte a character: 8 bytes
        of costs are kept, and the arcs that end at a place are found again from its end."""
        n = len(text)
        get, tail, longest, dear = self.table.get, self.tails.get, self.longest, self.dear
        best = array("q", [dear * (n + 1)]) * (n + 1)
        best[0] = 0
        for i in range(n):
            here = best[i]
            for j in range(i + 1, min(n, i + longest) + 1):
                hit = get(text[i:j])
                if hit is None:
                    break
                if hit and here + hit[1] < best[j]:
                    best[j] = here + hit[1]
            if here + dear < best[i + 1] and not get(text[i]):
                best[i + 1] = here + dear

        def arcs(end: int) -> list[tuple[int, int, int, int]]:
            found = []
            for start in range(end - 1, max(0, end - longest) - 1, -1):
                hit = tail(text[start:end])
                if hit is None:
                    break
                if hit:
                    found.append((best[start] + hit[1], hit[1], hit[0], start))
            if not get(text[end - 1]):
                found.append((best[end - 1] + dear, dear, -1 - ord(text[end - 1]), end - 1))
            found.sort()
            return found

        return arcs, best[n]

    def segmentations(self, text: str) -> list[tuple[int, list[int]]]:
        """Cost and pieces (ids; of characters without one, their negated code points less
        1) of up to n segmentations of text, in order."""
        arcs, last = self._lattice(text) if len(text) <= ARCS else self._long_lattice(text)
        out: list = []
        tick, most = 0, self.n
        agenda: list = [(last, len(text), 0, 0, None)]  # estimate, place, tie, cost so far, pieces after it
        while agenda and most:
            estimate, end, _, far, link = agenda.pop(0)
            if not end:
                ids = []
                while link:
                    ids.append(link[0])
                    link = link[1]
                out.append((estimate, ids))
                most -= 1
                del agenda[most:]
                continue
            for through, cost, piece, start in arcs(end):
                hope = far + through
                if len(agenda) >= most:
                    if hope >= agenda[-1][0]:
                        break  # as do all that follow
                    agenda.pop()
                tick += 1
                insort(agenda, (hope, start, tick, far + cost, (piece, link)))
        return out

    def _ids(self, found: list[int]) -> list[int]:
        if not found or min(found) >= 0:
            return found
        out = []
        for p in found:
            if p >= 0:
                out.append(p)
            else:
                raw = chr(-1 - p).encode("utf-8", "replace")
                out += [self.of_byte[b] for b in raw] if self.of_byte else [self.unknown]
        return out

    def _slots(self, hashes: np.ndarray, spell) -> np.ndarray:
        get = self.slot.get
        out = np.array([get(h, -1) for h in hashes.tolist()], np.int64)
        new = np.flatnonzero(out < 0)
        flat: list[int] = []
        sizes: list[int] = []
        costs: list[int] = []
        for i in new.tolist():
            found = self.segmentations(spell(i))
            for cost, p in found:
                ids = self._ids(p)
                flat += ids
                sizes.append(len(ids))
                costs.append(cost)
            sizes += [0] * (self.n - len(found))
            costs += [-1] * (self.n - len(found))
        first, end = len(self.slot), len(self.slot) + len(new)
        while end > len(self.cost):
            self.cost, self.size, self.at = (np.concatenate([x, np.zeros_like(x)]) for x in (self.cost, self.size, self.at))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(flat)] = flat
        size = np.array(sizes, np.int64)
        self.cost[first:end], self.size[first:end] = np.array(costs, np.int64).reshape(-1, self.n), size.reshape(-1, self.n)
        self.at[first:end] = (self.used + np.cumsum(size) - size).reshape(-1, self.n)
        self.used += len(flat)
        out[new] = np.arange(first, end)
        self.slot.update(zip(hashes[new].tolist(), range(first, end), strict=True))
        return out

    def _choices(self, slots: np.ndarray) -> list[tuple[int, tuple]]:
        """The n cheapest choices for a chain of lattices: further cost, and (place, ids)
        of what is not the best there."""
        if self.n == 1:
            return [(0, ())]
        more = np.where(self.cost[slots, 1] < 0, -1, self.cost[slots, 1] - self.cost[slots, 0])
        at = np.flatnonzero(more >= 0)
        if len(at) >= self.n:
            key = (np.minimum(more[at], 1 << 34) << 28) | np.arange(len(at))
            at = at[np.sort(np.argpartition(key, self.n - 1)[: self.n - 1])]
        out: list[tuple[int, tuple]] = [(0, ())]
        for i in at.tolist():
            costs, sizes, begins = (x[slots[i]].tolist() for x in (self.cost, self.size, self.at))
            others = [(c - costs[0], self.flat[b : b + m]) for c, m, b in zip(costs[1:], sizes[1:], begins[1:], strict=True) if c >= 0]
            every = out + [(cost + extra, (*changed, (i, ids))) for cost, changed in out for extra, ids in others]
            out = sorted(every, key=lambda x: x[0])[: self.n]
        return out

    def encode(self, column):
        """For each text of a string column, the ids and costs of up to n segmentations."""
        raw, offsets = buffers(column)
        for a, b in pieces(offsets, 1 << 20):
            texts = [raw[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace") for i in range(a, b)]
            texts = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
            cut = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            whole = "".join(texts)
            code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            if len(self.slot) > _CACHED:
                self.clear()
            first = np.zeros(len(code) + 1, bool)
            first[cut] = True
            first = first[:-1]
            low, high = code[:-1], code[1:]
            narrow = (low < 128) & (high < 128)
            glued = np.zeros(len(code), bool)
            inner = glued[1:]
            inner[narrow] = self.ascii[low[narrow], high[narrow]]
            inner[~narrow] = np.isin((low[~narrow] << 21) | high[~narrow], self.joined)
            starts = np.flatnonzero(first | ~glued)
            ends = np.append(starts[1:], len(code)) if len(starts) else starts
            hashes, one, which = np.unique(hash_spans(code, starts, ends), return_index=True, return_inverse=True)
            slots = self._slots(hashes, lambda i: whole[starts[one[i]] : ends[one[i]]])[which] if len(starts) else np.zeros(0, np.int64)  # noqa: B023
            size = self.size[slots, 0].astype(np.int64)
            upto = np.concatenate([[0], np.cumsum(size)])
            ids = self.flat[np.arange(upto[-1]) - np.repeat(upto[:-1], size) + np.repeat(self.at[slots, 0], size)]
            bound = np.searchsorted(starts, cut)
            for i in range(b - a):
                s, e = bound[i], bound[i + 1]
                base, here = int(self.cost[slots[s:e], 0].sum()), upto[s : e + 1]
                found = []
                for extra, changed in self._choices(slots[s:e]):
                    parts, at = [], here[0]
                    for place, other in changed:
                        parts += [ids[at : here[place]], other]
                        at = here[place + 1]
                    parts.append(ids[at : here[-1]])
                    found.append((base + extra, np.concatenate(parts) if changed else parts[0]))
                yield found

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; ids beyond the vocabulary are unknown ones."""
        ids = np.where((ids >= 0) & (ids < len(self.raw_at)), ids, self.unknown)
        size = self.raw_size[ids]
        first = np.cumsum(size) - size
        raw = self.raw[np.arange(int(size.sum())) - np.repeat(first, size) + np.repeat(self.raw_at[ids], size)].tobytes()
        return raw.removeprefix(b" ").decode("utf-8", "replace")


def model(path: str, n: int = N_BEST) -> PieceModel:
    if (path, n) not in _MODELS:
        _MODELS[path, n] = PieceModel(path, n)
    return _MODELS[path, n]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def encoded(docs: DataFrame, path: str, n: int = N_BEST) -> DataFrame:
    """doc_id, rank (from 1), score, ids: a row for each of the n best segmentations."""

    @lean
    def run(batches):
        for batch in batches:
            for doc, found in zip(batch.column("doc_id").to_pylist(), model(path, n).encode(batch.column("text")), strict=True):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([doc] * len(found), pa.int64()),
                        pa.array(range(1, len(found) + 1), pa.int32()),
                        pa.array([-cost / UNIT for cost, _ in found], pa.float64()),
                        pa.array([ids for _, ids in found], pa.list_(pa.int32())),
                    ],
                    ["doc_id", "rank", "score", "ids"],
                )

    return _texts(docs).mapInArrow(run, "doc_id long, rank int, score double, ids array<int>")


def decoded(rows: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and text of each row's ids."""

    @lean
    def run(batches):
        for batch in batches:
            lists = batch.column(1).to_pylist()
            texts = [model(path).decode(np.array([i for i in x or [] if i is not None], np.int64)) for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    some = rows.select(key, F.col(ids).cast("array<long>").alias("ids"))
    return some.mapInArrow(run, f"`{key}` {some.schema[0].dataType.simpleString()}, text string")


_OUT = "doc_id long, n_pieces long, score double, ids_crc32 long, nbest_scores array<double>, nbest_crc32 array<long>, decoded_sha256 string"


def report(docs: DataFrame, path: str, n: int = N_BEST) -> DataFrame:
    """For each row of docs: number of pieces, score and CRC-32 of the best segmentation's
    ids (unsigned, of little-endian 32-bit ids), scores and CRCs of the n best, and the
    SHA-256 of what the best ids decode to."""

    @lean
    def run(batches):
        own = model(path, n)
        crc = lambda ids: zlib.crc32(ids.astype("<u4").tobytes())
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for found in own.encode(batch.column("text")):
                scores, sums = [-cost / UNIT for cost, _ in found], [crc(ids) for _, ids in found]
                text = own.decode(found[0][1])
                for c, v in zip(cols, (len(found[0][1]), scores[0], sums[0], scores, sums, hashlib.sha256(text.encode()).hexdigest()), strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))],
                ["doc_id", "n_pieces", "score", "ids_crc32", "nbest_scores", "nbest_crc32", "decoded_sha256"],
            )

    return _texts(docs).mapInArrow(run, _OUT)
