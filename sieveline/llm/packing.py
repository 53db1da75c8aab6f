"""Cost-balanced packing of token sequences.

A document's ids, with the end id, are cut at the sequence length; what remains of it is
packed. The cost of a piece is estimated as length + QUADRATIC * length**2: the linear
layers, and attention within the piece. Pieces of a window are taken by descending cost;
each goes to the sequence of lowest cost that still has room for it. The window's
sequences have room for just its ids: full ones, and for the rest lengths that are powers
of two, which need no padding. A piece that fits nowhere is cut over the sequences of
lowest cost with room.

A window is what one task has read, in stretches of up to WINDOW pieces, so that nothing is
shuffled and memory doesn't grow with the table; a task that runs again packs its rows
again and replaces all it gave.

Cases: a null text is empty, and an empty text is the end id alone; rows are packed one by
one, so repeated rows and equal or null ids are documents of their own; no rows give no
rows; texts are taken whole; other columns are left out.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import lean

LENGTH, END, WINDOW, QUADRATIC = 1024, 0, 8192, 1 / 2048


def pack(lengths: np.ndarray, length: int = LENGTH, quadratic: float = QUADRATIC) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (index, start within it, length, sequence, offset), and how many sequences."""
    total = int(lengths.sum())
    room = np.array([length] * (total // length) + [1 << b for b in range(length.bit_length(), -1, -1) if total % length >> b & 1], np.int64)
    whole = room.copy()
    cost = np.zeros(len(room))
    out, late = [], []

    def put(i: int, start: int, n: int, s: int) -> None:
        out.append((i, start, n, s, int(whole[s] - room[s])))
        room[s] -= n
        cost[s] += n + quadratic * n * n

    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        s = int(np.argmin(np.where(room >= n, cost, np.inf)))
        if room[s] >= n:
            put(i, 0, n, s)
        else:
            late.append(i)
    for i in late:
        start, n = 0, int(lengths[i])
        while start < n:
            s = int(np.argmin(np.where(room > 0, cost, np.inf)))
            m = min(n - start, int(room[s]))
            put(i, start, m, s)
            start += m
    return out, len(room)


def _packer(path: str, length: int, end: int, window: int, quadratic: float):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    @lean
    def run(batches):
        code = encoder(path)
        next_id = TaskContext.get().partitionId() << 36
        held: list[tuple] = []

        def rows(found):
            cols = list(zip(*found, strict=True)) if found else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

        def flush():
            nonlocal next_id
            placed, n = pack(np.array([len(h[2]) for h in held], np.int64), length, quadratic)
            found = []
            for i, start, m, s, offset in placed:
                doc, base, ids, tokens = held[i]
                found.append((doc, base + start, m, zlib.crc32(ids[start : start + m].astype("<u4").tobytes()), tokens, next_id + s, offset))
            next_id += n
            held.clear()
            return rows(found)

        for batch in batches:
            found = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), code.encode(batch.column("text")), strict=True):
                ids = np.append(ids, np.uint32(end))
                full = len(ids) - len(ids) % length
                for start in range(0, full, length):
                    found.append((doc, start, length, zlib.crc32(ids[start : start + length].astype("<u4").tobytes()), len(ids), next_id, 0))
                    next_id += 1
                if full < len(ids):
                    held.append((doc, full, ids[full:].copy(), len(ids)))
                    if len(held) >= window:
                        yield flush()
                if len(found) >= 50_000:
                    yield rows(found)
                    found = []
            yield rows(found)
        if held:
            yield flush()

    return run


def packed(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, window: int = WINDOW, quadratic: float = QUADRATIC) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset. path: a byte-level BPE file of the `tokenizers` library."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return docs.mapInArrow(
        _packer(path, length, end, window, quadratic), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
