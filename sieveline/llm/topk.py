"""Exact top-k inner-product search by MaxScore over blocks of postings.

Every dimension is a term, whose posting lists the rows with a component there other than 0.
A shard's rows are ordered by their strongest component and cut into blocks, of which each
knows, for every term, its largest and least component, and its rows' largest length. The
blocks are taken by descending bound of what a query can score there; the k-th score so far
is the threshold, which only rises, from block to block and from shard to shard, and ends the
search where no block's bound reaches it.

In a block, the query's terms stand by descending score bound. The longest tail of terms that
together can't reach the threshold is non-essential: what they can add is at most the sum of
their bounds, and at most the product of the tail's length in the query and in the row, by
Cauchy and Schwarz. Essential postings are traversed and add up scores; rows that none of them
holds can't compete. The others are probed in the remaining terms, some at a time, while their
score and what is left can still reach the threshold; a tie still competes, as the smaller id
wins. A row that lasts has been scored in full, and keeps that score.

Rows and queries are laid out as a grid of cells, whatever the size of the table: a cell has at
most GROUP queries, and takes its rows by shards of at most SHARD, one after the other, so that
its memory is bounded; each row is sent to as many cells as there are groups of queries, and
each cell sends back k rows a query. The cells' lists are merged by rank.

Cases: vectors that are null, empty, or hold a null or non-finite component, or one that isn't
finite when scaled, take no part; a shorter vector is zero beyond its end, and one much longer
than others costs its own components only; rows equal in id and vector are searched once and
count as often as they stand, as candidates and as queries, and different vectors under one id
are rows of their own; null ids take no part; ties go to the smaller id; an empty table gives no
rows; other columns are left out. Sums are exact: in doubles where they can't pass 2**53, else
in 64-bit integers, else in Python's integers, which are slow; a score beyond the range of a
long is given as the nearest long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, stored

SHARD, GROUP, BLOCK, PROBE = 8192, 8192, 2048, 8
SHARD_VALUES = 1 << 20  # components a shard is planned to have at most, on average
SHARDS_A_CELL = 32
_LONG = 2**63 - 1


def _sortable(n: int) -> bytes:
    """Bytes that sort as whole numbers of any size do."""
    size = (abs(n).bit_length() + 7) // 8
    body = abs(n).to_bytes(size, "big")
    return (0x8000 + (size if n >= 0 else -size)).to_bytes(2, "big") + (body if n >= 0 else bytes(255 - b for b in body))


def _double(n: int) -> float:
    return float(max(-(10**300), min(10**300, n)))


class Best:
    """The k best of what was offered: (-score, id, copies), in order. With fewer than k the
    threshold is None."""

    def __init__(self, k: int):
        self.k, self.items, self.threshold = k, [], None

    def offer(self, scores: np.ndarray, ids: np.ndarray, copies: np.ndarray) -> None:
        some = np.flatnonzero(copies > 0)
        if len(some) > self.k:
            # copies can only raise the k-th score further
            some = some[scores[some] >= np.partition(scores[some], -self.k)[-self.k]]
        new = [(-int(scores[i]), int(ids[i]), int(copies[i])) for i in some.tolist()]
        self.items, n = sorted(self.items + new), 0
        for i, (score, _, c) in enumerate(self.items):
            n += c
            if n >= self.k:
                del self.items[i + 1 :]
                self.threshold = -score
                break

    def floor(self) -> float:
        """A double that is surely no greater than the threshold."""
        t = _double(self.threshold)
        return t - abs(t) * 1e-12 - 1.0

    def rows(self):
        left = self.k
        for score, row, c in self.items:
            for _ in range(min(c, left)):
                yield row, max(-_LONG, min(_LONG, -score)), _sortable(-score)
            left -= min(c, left)


class Shard:
    """The postings of up to SHARD rows, each of (dimension, component other than 0)."""

    def __init__(self, ids, hashes, copies, lens, dims, values, block: int = BLOCK):
        n = len(ids)
        row = np.repeat(np.arange(n), lens)
        peak = np.zeros(n, np.int64)
        if len(values):
            order = np.lexsort((-np.abs(values), row))
            first = order[np.concatenate([[True], row[order][1:] != row[order][:-1]])]
            peak[row[first]] = 2 * dims[first] + (values[first] > 0) + 1
        order = np.lexsort((ids, peak))
        self.ids, self.hashes, self.copies = ids[order], hashes[order], copies[order]
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        row = place[row]
        # a posting of most rows lists the others too, with 0, and needs no look-up
        kinds, of, size = np.unique(dims, return_inverse=True, return_counts=True)
        wide = np.flatnonzero((2 * size >= n) & (size < n))
        if len(wide):
            lacks = np.ones((len(wide), n), bool)
            at = np.searchsorted(wide, of)
            at[at == len(wide)] = 0
            some = wide[at] == of
            lacks[at[some], row[some]] = False
            which, rest = np.nonzero(lacks)
            row, dims, values = np.append(row, rest), np.append(dims, kinds[wide[which]]), np.append(values, np.zeros(len(rest)))
        by = np.lexsort((row, dims))
        self.row, self.value = row[by], values[by]
        self.dims, which = np.unique(dims[by], return_inverse=True)
        self.edges = np.append(np.arange(0, n, block), n)
        cell = which * (len(self.edges) - 1) + self.row // block
        cells = len(self.dims) * (len(self.edges) - 1)
        self.start = np.searchsorted(cell, np.arange(cells + 1)).reshape(-1)
        self.high, self.low = np.zeros(cells), np.zeros(cells)
        np.maximum.at(self.high, cell, self.value)
        np.minimum.at(self.low, cell, self.value)
        shape = (len(self.dims), len(self.edges) - 1)
        full = (np.diff(self.start).reshape(shape) == np.diff(self.edges)).ravel()
        if full.any():  # no row there is 0, so the bounds may be on one side of it
            got = np.flatnonzero(full)
            self.high[got] = np.maximum.reduceat(self.value, self.start[got]) if len(got) == cells else [self.value[self.start[c] : self.start[c + 1]].max() for c in got]
            self.low[got] = np.minimum.reduceat(self.value, self.start[got]) if len(got) == cells else [self.value[self.start[c] : self.start[c + 1]].min() for c in got]
        self.high, self.low = self.high.reshape(shape), self.low.reshape(shape)
        self.square = np.zeros(n)
        with np.errstate(over="ignore"):
            self.squared = self.value * self.value
            np.add.at(self.square, self.row, self.squared)
            self.square *= 1 + 1e-9  # more than what rounding can make of a rest of it
            self.length = np.array([np.sqrt(self.square[a:b].max()) if b > a else 0.0 for a, b in zip(self.edges[:-1], self.edges[1:], strict=True)])
        self.exact = {}
        self.largest = float(np.abs(values).max()) if len(values) else 0.0
        self.longest = int(lens.max()) if n else 0

    def values(self, kind) -> np.ndarray:
        if kind not in self.exact:
            self.exact[kind] = self.value if kind is float else self.value.astype(np.int64) if kind is int else np.array([int(v) for v in self.value.tolist()], object)
        return self.exact[kind]

    def search(self, dims: np.ndarray, query: np.ndarray, own: tuple[int, int], best: Best) -> int:
        """Offers what competes to `best`; own: id and hash of the query, one copy of which is
        no candidate. How many rows were scored in full."""
        at = np.searchsorted(self.dims, dims)
        held = at < len(self.dims)
        held[held] = self.dims[at[held]] == dims[held]
        at, q = at[held], query[held]
        most = self.largest * float(np.abs(query).max() if len(query) else 0.0) * max(self.longest, 1)
        kind = float if most < 2.0**53 else int if most < 2.0**63 else object
        exact_q = q if kind is float else q.astype(np.int64) if kind is int else np.array([int(x) for x in q.tolist()], object)
        value = self.values(kind)
        copies = self.copies
        mine = np.flatnonzero((self.ids == own[0]) & (self.hashes == own[1]))
        if len(mine):
            copies = copies.copy()
            copies[mine] -= 1
        blocks = len(self.edges) - 1
        with np.errstate(all="ignore"):
            bound = np.maximum(q[:, None] * self.high[at], q[:, None] * self.low[at])
            bound += np.abs(bound) * 1e-9
            whole = np.minimum(bound.sum(axis=0) if len(at) else np.zeros(blocks), np.sqrt((q * q).sum()) * self.length * (1 + 1e-9))
        scored = 0
        for b in np.argsort(-whole, kind="stable").tolist():
            if best.threshold is not None and whole[b] < best.floor():
                break
            scored += self._block(b, at, q, exact_q, value, bound[:, b], kind, copies, best)
        return scored

    def _block(self, b, at, q, exact_q, value, bound, kind, copies, best) -> int:
        low, n = int(self.edges[b]), int(self.edges[b + 1] - self.edges[b])
        blocks = len(self.edges) - 1
        order = np.argsort(-bound, kind="stable")
        at, q, exact_q, bound = at[order], q[order], exact_q[order], bound[order]
        with np.errstate(all="ignore"):
            ahead = np.append(np.cumsum(bound[::-1])[::-1], 0.0)  # of all terms from one on
            rest = np.append(np.sqrt(np.cumsum((q * q)[::-1])[::-1]), 0.0) * (1 + 1e-9)
            limit = np.minimum(ahead, rest * self.length[b])
        floor = None if best.threshold is None else best.floor()
        essential = len(at) if floor is None or not (limit < floor).any() else int(np.argmax(limit < floor))
        score = np.zeros(n, np.float64 if kind is float else np.int64 if kind is int else object)
        square = self.square[low : low + n].copy()
        met = np.zeros(n, bool)
        for i in range(essential):
            a, z = self.start[at[i] * blocks + b], self.start[at[i] * blocks + b + 1]
            if z - a == n:
                score += exact_q[i] * value[a:z]
                square -= self.squared[a:z]
                met[:] = True
            else:
                rows = self.row[a:z] - low
                score[rows] += exact_q[i] * value[a:z]
                square[rows] -= self.squared[a:z]
                met[rows] = True
        alive = np.flatnonzero(met) if floor is not None and limit[essential] < floor else np.arange(n)
        score, square = score[alive], square[alive]
        for i in range(essential, len(at)):
            if (i - essential) % PROBE == 0 and floor is not None:
                going = self._competes(score, square, rest[i], ahead[i], floor)
                alive, score, square = alive[going], score[going], square[going]
                if not len(alive):
                    return 0
            a, z = self.start[at[i] * blocks + b], self.start[at[i] * blocks + b + 1]
            if z - a == n:
                score = score + exact_q[i] * value[a + alive]
                square = square - self.squared[a + alive]
            elif z > a:
                rows = self.row[a:z] - low
                found = np.minimum(np.searchsorted(rows, alive), len(rows) - 1)
                hit = np.flatnonzero(rows[found] == alive)
                score[hit] += exact_q[i] * value[a + found[hit]]
                square[hit] -= self.squared[a + found[hit]]
        if floor is not None:
            bottom = best.threshold if kind is object else max(-(2**62), min(2**62, best.threshold))
            going = np.flatnonzero(score >= bottom)
            alive, score = alive[going], score[going]
        if len(alive):
            best.offer(score, self.ids[low + alive], copies[low + alive])
        return len(alive)

    @staticmethod
    def _competes(score, square, rest, ahead, floor) -> np.ndarray:
        """Not those that are sure to stay below the threshold."""
        now = np.array([_double(x) for x in score.tolist()]) if score.dtype == object else score
        with np.errstate(all="ignore"):
            return ~(now + np.minimum(np.sqrt(np.maximum(square, 0.0)) * rest, ahead) < floor)


def _sparse(table: pa.Table):
    """Lengths, dimensions and components other than 0 of each vector."""
    col = table.column("v").combine_chunks()
    lens = np.asarray(col.value_lengths(), np.int64)
    flat = np.asarray(col.flatten(), np.float64)
    row = np.repeat(np.arange(len(lens)), lens)
    dims = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
    some = flat != 0
    return np.bincount(row[some], minlength=len(lens)), dims[some], flat[some]


def _cells(k: int):
    """Rows come by cell: its queries (shard -1), then its shards."""
    schema = pa.schema([("query_id", pa.int64()), ("query_hash", pa.int64()), ("query_copies", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("key", pa.binary())])

    @lean
    def run(batches):
        held: list[pa.Table] = []
        last, queries = None, []

        def take():
            nonlocal queries
            t = pa.concat_tables(held)
            ids, hashes, copies = (np.asarray(t.column(c), np.int64) for c in ("id", "h", "n"))
            lens, dims, values = _sparse(t)
            if last[2] < 0:
                cuts = np.concatenate([[0], np.cumsum(lens)])
                queries = [(int(ids[i]), int(hashes[i]), int(copies[i]), dims[cuts[i] : cuts[i + 1]], values[cuts[i] : cuts[i + 1]], Best(k)) for i in range(len(ids))]
            elif queries:
                part = Shard(ids, hashes, copies, lens, dims, values)
                for own, h, _, d, v, best in queries:
                    part.search(d, v, (own, h), best)

        def give():
            rows = [(own, h, n, *row) for own, h, n, _, _, best in queries for row in best.rows()]
            queries.clear()
            for i in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 50_000], strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            keys = np.stack([np.asarray(batch.column(c)) for c in ("g", "u", "s")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, z in zip(cuts, cuts[1:]):  # noqa: B905
                if a == z:
                    continue
                key = tuple(keys[a].tolist())
                if key != last:
                    if held:
                        take()
                        held = []
                    if last is not None and key[:2] != last[:2]:
                        yield from give()
                    last = key
                held.append(pa.Table.from_batches([batch.slice(a, z - a)]))
        if held:
            take()
            yield from give()

    return run


def top_k(vectors: DataFrame, k: int = 5, query_every: int = 50, scale: int = 256, id_col: str = "vec_id", vector: str = "embedding", shard: int = SHARD, group: int = GROUP) -> DataFrame:
    """query_id, rank, vec_id, score of every query's k best rows."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    # beyond 2**53 every double is whole, and floor() would go through a long
    whole = lambda c: F.when(F.abs(c) < 2.0**53, F.floor(c).cast("double")).otherwise(c)
    ready = (
        vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector), lambda c: c.cast("double") * scale).alias("v"))
        .where(F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", finite))
        .select("id", F.transform("v", whole).alias("v"))
        .groupBy("id", "v")
        .agg(F.count("*").alias("n"))
    )
    ready = stored(ready.select("id", F.xxhash64("v").alias("h"), "n", "v"), "vectors")
    asks = F.col("id") % query_every == 0
    n, queries, values = ready.select(F.count("*"), F.count_if(asks), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    shards, groups = max(1, -(-n // shard), -(-values // SHARD_VALUES)), max(1, -(-queries // group))
    per = max(1, min(SHARDS_A_CELL, shards * groups // (4 * vectors.sparkSession.sparkContext.defaultParallelism)))
    cells = -(-shards // per)
    lane = lambda m, seed: F.pmod(F.xxhash64("id", "h", F.lit(seed)), F.lit(m)).cast("int")
    rows = ready.withColumn("s", lane(shards, 1)).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("u", F.floor(F.col("s") / per).cast("int"))
    asked = ready.where(asks).withColumn("g", lane(groups, 2)).withColumn("u", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))).withColumn("s", F.lit(-1))
    names = ["g", "u", "s", "id", "h", "n", "v"]
    laid = rows.select(names).unionByName(asked.select(names)).repartition(4 * groups * cells, "g", "u").sortWithinPartitions("g", "u", "s", "id", "h")
    lists = laid.mapInArrow(_cells(k), "query_id long, query_hash long, query_copies long, vec_id long, score long, key binary")
    order = Window.partitionBy("query_id", "query_hash").orderBy(F.desc("key"), "vec_id")
    best = lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "query_copies"))).select("query_id", "rank", "vec_id", "score")
