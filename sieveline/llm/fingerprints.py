"""Document fingerprints by consistent weighted sampling.

A text's terms are its word shingles (five words; of fewer words, all of them), weighted
by their counts S. For each of 64 samples a term draws r and c from Gamma(2, 1) and b from
[0, 1), all from a hash of the term, and t = floor(ln S / r + b); the sample is the pair
(term, t) with the least ln c - r * (t - b + 1). Two texts agree in a sample with the
probability of their generalised Jaccard similarity, sum of least over sum of greatest
weights. 16 bits of the pair's hash are kept of each sample, 64 samples as 256 hex digits.
The draws come from tables of 65,536 quantiles; terms that tie in a draw go by the hash of
their pairs. That is as fair among terms of equal weight; of a text with far more than 65,536
different terms many share the least draw, and there a greater weight counts for less than it
should.

What a document is compared with, the next one by ascending id, is found by range: ids
are cut into buckets at sampled quantiles, buckets are sorted, and the first document of
each is also sent to the bucket before, the first of all to the last.

Cases: a null text is empty; texts without words have the fingerprint of zeros, and two
such are alike (1.0); null ids sort first; rows with equal ids are ordered by a hash of
their text, and of rows equal in both each is followed by the other; a single row follows
itself; an empty table gives no rows; texts are taken whole; other columns are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, buffers, hash_spans, lean, splitmix, words

SAMPLES, WORDS = 64, 5
BUCKETS, BUCKET_BYTES = 20_000, 64 << 20  # more buckets than there are partitions only for large inputs, and no more than these
_RNG = np.random.default_rng(31337)
_XOR = _RNG.integers(0, 2**63, SAMPLES, dtype=np.uint64)
_MUL = _RNG.integers(0, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RNG.integers(0, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _gamma2(p: np.ndarray) -> np.ndarray:
    """Quantiles of Gamma(2, 1): x with 1 - (1 + x) * exp(-x) = p, by Newton steps."""
    x = np.sqrt(2 * p) + p
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / np.maximum(x * np.exp(-x), 1e-300), 1e-9)
    return x


_Q = (np.arange(65536) + 0.5) / 65536
_LOG_C = np.log(_gamma2(_Q)).astype(np.float32)
_R = _RNG.permutation(_gamma2(_Q))
_B = _RNG.permutation(_Q)
_R_REST = (_R * (1 - _B)).astype(np.float32)
_OFFSET, _SCALE = np.float32(64), np.float32(2.0**32 / 96)


def terms(column, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Row and shingle hash of every shingle of each text; equal ones are repeated."""
    raw, offsets = buffers(column)
    data = LOWER[raw]
    starts, ends, row = words(data, offsets)
    hashed = hash_spans(data, starts, ends)
    n = max(0, len(hashed) - width + 1)
    with np.errstate(over="ignore"):
        full = np.zeros(n, np.uint64)
        for j in range(width):
            full += hashed[j : j + n] * _PLACE[j]
        whole = row[:n] == row[width - 1 : width - 1 + n]
        counts = np.bincount(row, minlength=len(offsets) - 1)
        short = np.flatnonzero((counts > 0) & (counts < width))
        first = np.searchsorted(row, short)
        rest = np.array([np.sum(hashed[f : f + c] * _PLACE[:c]) + np.uint64(c) for f, c in zip(first, counts[short], strict=True)], np.uint64)
    out_row = np.concatenate([row[:n][whole], short])
    return out_row, splitmix(np.concatenate([full[whole], rest]))


def _sample(term: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """For sample k, each term's value in the high and its pair's hash in the low half."""
    with np.errstate(over="ignore"):
        x = (term ^ _XOR[k]) * _MUL[k]
        x ^= x >> np.uint64(29)
        part = x.view(np.uint16).reshape(-1, 4)
        at = part[:, 2]
        value = _LOG_C[part[:, 3]] - _R_REST[at]
        pair = x * np.uint64(0x9E3779B97F4A7C15)
        many = np.flatnonzero(weight > 1)
        if len(many):
            r, b = _R[at[many]], _B[at[many]]
            t = np.floor(np.log(weight[many]) / r + b)
            value[many] = _LOG_C[part[many, 3]] - r * (t - b + 1)
            # t is 0 for a weight of 1, whose pair is not hashed again
            pair[many] = np.where(t == 0, pair[many], splitmix(pair[many] + t.astype(np.uint64)))
        order = ((value + _OFFSET) * _SCALE).astype(np.uint64)
        return (order << np.uint64(32)) | (pair >> np.uint64(32))


def fingerprints(column) -> np.ndarray:
    """A row of SAMPLES 16-bit numbers for each text."""
    n = len(column)
    out = np.zeros((n, SAMPLES), np.uint16)
    row, term = terms(column)
    if not len(row):
        return out
    order = np.lexsort((term, row))
    row, term = row[order], term[order]
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (term[1:] != term[:-1])]))
    weight = np.diff(np.append(new, len(row)))
    row, term = row[new], term[new]
    # the same term of the same weight, in a text and its edited form, is drawn once
    with np.errstate(over="ignore"):
        one = np.unique(splitmix(term) + weight.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), return_index=True, return_inverse=True)
    term, weight, which = term[one[1]], weight[one[1]], one[2]
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    for k in range(SAMPLES):
        out[row[first], k] = np.minimum.reduceat(_sample(term, weight, k)[which], first).astype(np.uint16)
    return out


def spelled(prints: np.ndarray) -> list[str]:
    return [p.astype(">u2").tobytes().hex() for p in prints]


def edited(text: str, following: str) -> str:
    """text with its last quarter of code points replaced by the first of the other."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


@lean
def _compare(batches):
    """Rows come by bucket and id; a row waits for the one after it."""

    def finish(rows):
        """rows: (bucket, id, text) of which the last only follows."""
        texts = [r[2] for r in rows]
        new = [edited(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)]
        some = [i for i in range(len(rows) - 1) if rows[i][0] == rows[i + 1][0] and not rows[i][3]]
        if not some:
            return
        prints = fingerprints(pa.array([*texts, *(new[i] for i in some)], pa.string()))
        other = prints[len(texts) :]
        own, after = prints[some], prints[[i + 1 for i in some]]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][1] for i in some], pa.int64()),
                pa.array([len(texts[i]) for i in some], pa.int64()),
                pa.array([hashlib.sha256(new[i].encode()).hexdigest() for i in some]),
                pa.array(spelled(own)),
                pa.array(spelled(other)),
                pa.array((own == other).mean(axis=1)),
                pa.array((own == after).mean(axis=1)),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    held, size = [], 0
    for batch in batches:
        raw, offsets = buffers(batch.column("text"))
        ids, buckets, guests = (batch.column(c).to_pylist() for c in ("doc_id", "bucket", "guest"))
        for i in range(batch.num_rows):
            if guests[i] and held and held[-1][3] and held[-1][0] == buckets[i]:
                continue  # a repeated first row
            text = raw[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")
            held.append((buckets[i], ids[i], text, guests[i]))
            size += len(text)
            if size > 1 << 18 and len(held) > 1:
                yield from finish(held)
                held = held[-1:]
                size = len(held[0][2])
    if len(held) > 1:
        yield from finish(held)


def _bucket(of, bounds: list[int]):
    """How many of the ascending bounds are not above a value, by binary search."""
    if not bounds:
        return F.lit(0)
    at = F.array(*map(F.lit, bounds)) if len(bounds) < 64 else F.from_json(F.lit(str(bounds)), "array<bigint>")
    steps = F.array(*(F.lit(1 << i) for i in range(len(bounds).bit_length() - 1, -1, -1)))
    return F.aggregate(steps, F.lit(0), lambda lo, s: lo + F.when((lo + s <= len(bounds)) & (F.get(at, lo + s - 1) <= of), s).otherwise(0))


def report(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    size = docs.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(BUCKETS, size // BUCKET_BYTES))
    found = docs.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.5 / parts) if parts > 1 else []
    bounds = sorted({int(x) for x in found})
    placed = docs.withColumn("own", _bucket(F.coalesce("doc_id", F.lit(-(2**63))), bounds)).withColumn("tie", F.xxhash64("text"))
    least = sorted(placed.groupBy("own").agg(F.min(F.struct("doc_id", "tie")).alias("f")).collect(), key=lambda r: r.own)
    firsts = spark.createDataFrame([(r.own, r.f.doc_id, r.f.tie, least[i - 1].own) for i, r in enumerate(least)], "own int, first_id long, first_tie long, before int")
    marked = placed.join(F.broadcast(firsts), "own", "left")
    lead = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("tie") == F.col("first_tie"))
    here = F.struct(F.col("own").alias("bucket"), F.lit(False).alias("guest"))
    sent = F.explode(F.when(lead, F.array(here, F.struct(F.col("before").alias("bucket"), F.lit(True).alias("guest")))).otherwise(F.array(here)))
    rows = marked.select("doc_id", "tie", "text", sent.alias("to")).select("doc_id", "tie", "text", "to.bucket", "to.guest")
    return rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "guest", "doc_id", "tie").mapInArrow(_compare, _SCHEMA)
