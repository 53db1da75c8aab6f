"""Near-duplicate detection: MinHash bands, sequential Bayesian pruning, exact checks.

1. A document's set of distinct word shingles is hashed; documents with equal sets are one
   class from here on, so copies cost nothing more and are never paired.
2. A class has a signature of 128 minima. Classes that share a band of it (25 bands of 5;
   28 of 4 at 80 percent) are candidates; each is tied to the least class of the band's
   bucket.
3. Ties are compared first: sizes must allow the similarity, and signatures must agree often
   enough, batch by batch, for the posterior chance of the similarity not to fall below the
   chosen miss probability. Survivors are verified on their full sets: a tied class's text goes
   to its bucket's least class, of which every TIED classes get a copy. So a family of near
   copies costs as much as it has members.
4. What those links connect needs no more comparison. Buckets that they leave in several pieces
   are connected to clusters; there, each class that isn't in the cluster's largest piece meets
   all others, in pairs of blocks of bounded rows and bytes, and classes that share a band and
   that no link connects yet are compared and verified in the same way. The largest piece is
   sent only as often as there are blocks of others.
5. Components of the verified links give each document the least id it is linked with.

A chance of missing a link remains: at the threshold, of 4e-7 from the bands (at 80
percent too) and of `miss` for each batch of the signature. In a cluster, classes outside of its largest
piece meet each other, so there the number of comparisons is quadratic.

Cases: a null or empty text, or one of white space, has no shingles, is linked with
nothing and is kept; a text of fewer words than a shingle is one shingle; repeated rows
are linked with each other, and of rows with equal ids all are kept if one is (the pipeline
takes one of them); a null id is no candidate for the least id, and a row whose component
has none but null ids is kept;
an empty table gives no rows; other columns are left out. Texts of any length are taken
whole.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, buffers, drop_stored, give_back, hash_spans, lean, own_columns, pieces, splitmix, stored, words
from .components import roots

HASHES, BANDS, ROWS, BATCH = 128, 25, 5, 32
WORDS, PERCENT, MISS = 5, 85, 1e-6
BAND_MISS = 5e-7
BLOCK_ROWS, BLOCK_SHINGLES, TIED, SALTS = 1024, 1_500_000, 256, 32
_RNG = np.random.default_rng(20240607)
_MUL = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)
_PLACE = _RNG.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column, width: int = WORDS):
    """The sorted distinct shingle hashes of each text, one after the other."""
    raw, offsets = buffers(column)
    for a, b in pieces(offsets, 1 << 21):
        at = offsets[a : b + 1] - offsets[a]
        data = LOWER[raw[offsets[a] : offsets[b]]]
        starts, ends, row = words(data, at)
        hashed = hash_spans(data, starts, ends)
        bounds = np.searchsorted(row, np.arange(b - a + 1))
        with np.errstate(over="ignore"):
            n = max(0, len(hashed) - width + 1)
            full = np.zeros(n, np.uint64)
            for j in range(width):
                full += hashed[j : j + n] * _PLACE[j]
            full = splitmix(full)
            for i in range(b - a):
                s, e = bounds[i], bounds[i + 1]
                if e - s >= width:
                    yield np.unique(full[s : e - width + 1])
                elif e > s:
                    yield splitmix(np.array([np.sum(hashed[s:e] * _PLACE[: e - s]) + np.uint64(e - s)], np.uint64))
                else:
                    yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    best = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), 256):
            np.minimum(best, (shingles[i : i + 256, None] * _MUL + _ADD).min(axis=0), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


def banding(percent: int = PERCENT) -> tuple[int, int]:
    """Bands and rows a band, as many rows and then as few bands as miss a pair at the
    threshold with a chance of BAND_MISS at most: BANDS of ROWS at PERCENT."""
    t = percent / 100
    for rows in range(ROWS, 1, -1):
        for bands in range(1, HASHES // rows + 1):
            if (1 - t**rows) ** bands <= BAND_MISS:
                return bands, rows
    return HASHES, 1


def band_keys(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of each signature; the band is part of the key."""
    parts = signatures[:, : bands * rows].reshape(len(signatures), bands, rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        return splitmix(splitmix((parts * _PLACE[:rows]).sum(axis=2, dtype=np.uint64)) + np.arange(bands, dtype=np.uint64))


def least_matches(n: int, percent: int = PERCENT, miss: float = MISS) -> int:
    """The fewest of n equal minima at which the similarity still may be percent or more:
    with a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail is a
    binomial sum."""
    t, total = percent / 100, 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def _rows(batches, fn):
    for batch in batches:
        if batch.num_rows:
            yield from fn(batch)
    give_back()


def _describe(batch: pa.RecordBatch):
    n, node, sig = [], [], []
    for s in shingle_sets(batch.column("text")):
        n.append(len(s))
        if len(s):
            with np.errstate(over="ignore"):
                two = np.array([splitmix(s).sum(dtype=np.uint64), splitmix(s ^ _PLACE[63]).sum(dtype=np.uint64)], np.uint64)
            node.append(two.tobytes())
            sig.append(signature(s).tobytes())
        else:
            node.append(None)
            sig.append(None)
    yield pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), batch.column("tkey"), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(sig, pa.binary())],
        ["doc_id", "tkey", "n_shingles", "node", "sig"],
    )


def _keyed(batch: pa.RecordBatch, bands: int, rows: int):
    sig = np.frombuffer(buffers(batch.column("sig"))[0].tobytes(), np.uint32).reshape(-1, HASHES)
    keys = pa.FixedSizeListArray.from_arrays(pa.array(band_keys(sig, bands, rows).astype(np.int64).ravel()), bands).cast(pa.list_(pa.int64()))
    yield pa.RecordBatch.from_arrays([batch.column("node"), keys], ["node", "keys"])


def _with_sets(batch: pa.RecordBatch):
    sets = pa.array([s.tobytes() for s in shingle_sets(batch.column("text"))], pa.binary())
    keep = ["node", "cluster", "comp", "minor", "minors", "majors", "sig"]
    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), sets], [*keep, "shingles"])


def _agreeing(percent: int, miss: float = MISS):
    """Of pairs with two signatures, those that the sequential test leaves."""

    def run(batch: pa.RecordBatch):
        a, b = (np.frombuffer(buffers(batch.column(c))[0].tobytes(), np.uint32).reshape(-1, HASHES) for c in ("sig", "other"))
        going, met = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
        for k in range(BATCH, HASHES + 1, BATCH):
            met = met + (a[going, k - BATCH : k] == b[going, k - BATCH : k]).sum(axis=1)
            some = met >= least_matches(k, percent, miss)
            going, met = going[some], met[some]
        yield batch.take(pa.array(going)).select(["u", "v", "of_u", "of_v"])

    return run


def _checked(percent: int):
    """Rows come by pivot and copy, the pivot's text first; verified ties leave."""

    @lean
    def run(batches):
        last, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            keys = list(zip(batch.column("v").to_pylist(), batch.column("copy").to_pylist(), strict=True))
            roles, nodes, found = batch.column("role").to_pylist(), batch.column("node").to_pylist(), []
            for key, role, node, s in zip(keys, roles, nodes, shingle_sets(batch.column("text")), strict=True):
                if not role:
                    last, own = key, s
                elif key == last:
                    both = len(np.intersect1d(own, s, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(s) - both):
                        found.append((node, key[0]))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], ["u", "v"])

    return run


def verified_links(nodes: list[bytes], sigs: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None = None, percent: int = PERCENT, miss: float = MISS, comp: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that span the components of the group; side: compare across sides only; comp: the
    components that are known."""
    n = len(nodes)
    keys, size = band_keys(sigs, *banding(percent)), np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    cut = np.concatenate([[0], np.cumsum(size)])
    present = np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool)
    need = [(k, least_matches(k, percent, miss)) for k in range(BATCH, HASHES + 1, BATCH)]
    comp, links = (np.arange(n) if comp is None else comp.copy()), []
    for a in range(n):
        other = np.flatnonzero(comp[a + 1 :] != comp[a]) + a + 1
        if side is not None:
            other = other[side[other] != side[a]]
        small, large = np.minimum(size[other], size[a]), np.maximum(size[other], size[a])
        other = other[100 * small >= percent * large]
        if len(other):
            other = other[(keys[other] == keys[a]).any(axis=1)]
        met = np.zeros(len(other), np.int64)
        for k, least in need:
            if not len(other):
                break
            met += (sigs[other, k - BATCH : k] == sigs[a, k - BATCH : k]).sum(axis=1)
            going = met >= least
            other, met = other[going], met[going]
        if not len(other):
            continue
        present[ids[cut[a] : cut[a + 1]]] = True
        for i in range(0, len(other), 512):
            some = other[i : i + 512]
            lens = size[some]
            first = np.concatenate([[0], np.cumsum(lens)[:-1]])
            at = np.arange(lens.sum()) - np.repeat(first, lens) + np.repeat(cut[some], lens)
            common = np.add.reduceat(present[ids[at]].astype(np.int64), first)
            for b in some[100 * common >= percent * (lens + size[a] - common)]:
                if comp[b] != comp[a]:
                    links.append((a, int(b)))
                    comp[comp == comp[b]] = comp[a]
        present[ids[cut[a] : cut[a + 1]]] = False
    return links


def _linked(percent: int):
    """Rows come ordered by cluster and pair of blocks; links of each group leave."""

    @lean
    def run(batches):
        held: list = []
        last = None

        def flush():
            seen, kept = set(), []
            for r in held:
                if r[0] not in seen:
                    seen.add(r[0])
                    kept.append(r)
            if len(kept) < 2:
                return
            nodes = [r[0] for r in kept]
            sigs = np.frombuffer(b"".join(r[1] for r in kept), np.uint32).reshape(-1, HASHES)
            sets = [np.frombuffer(r[2], np.uint64) for r in kept]
            side = np.array([r[3] for r in kept]) if last[1] != last[2] else None
            comp = np.unique(np.array([r[4] for r in kept], object), return_inverse=True)[1]
            found = verified_links(nodes, sigs, sets, side, percent, comp=comp)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([nodes[a] for a, _ in found], pa.binary()), pa.array([nodes[b] for _, b in found], pa.binary())], ["u", "v"])

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("cluster", "i", "j", "node", "sig", "shingles", "block", "comp")]
            for cluster, i, j, *row in zip(*cols, strict=True):
                if (cluster, i, j) != last:
                    if held:
                        yield from flush()
                    held, last = [], (cluster, i, j)
                held.append(row)
        if held:
            yield from flush()

    return run


def _label(doc_id: Column, node: Column) -> Column:
    """A class's name: 8 bytes that sort as its least id does, a null one last, and its
    hash. The least name of a component then holds the component's least id."""
    ordered = F.unhex(F.lpad(F.hex(doc_id.bitwiseXOR(F.lit(-(2**63)))), 16, "0"))
    return F.concat(F.coalesce(ordered, F.lit(b"\xff" * 8)), node)


def _id_of(label: Column) -> Column:
    first = F.substring(label, 1, 8)
    number = F.conv(F.hex(first), 16, 10).cast("decimal(20,0)") - F.lit("9223372036854775808").cast("decimal(20,0)")
    return F.when(first != F.lit(b"\xff" * 8), number.cast("long"))


def components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs(doc_id, text); linked is
    what has a similarity of percent or more."""
    return _judged(docs, percent).select("doc_id", "n_shingles", "component_id", "kept")


def _judged(docs: DataFrame, percent: int) -> DataFrame:
    """The columns of components(), tkey, a hash of the row's text, and chosen: whether the
    row's id and text are the one pair that stands for its component."""
    n_bands, n_rows = banding(percent)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    keyed = docs.withColumn("tkey", F.xxhash64("text"))
    seen = stored(keyed.mapInArrow(lambda it: _rows(it, _describe), "doc_id long, tkey long, n_shingles long, node binary, sig binary"), "shingles")
    each = seen.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("id"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey")).alias("of"), F.min("n_shingles").alias("n"), F.first("sig").alias("sig"))
    classes = stored(each.select(_label(F.col("id"), F.col("node")).alias("node"), F.col("node").alias("hash"), "of", "n", "sig"), "classes")
    bands = classes.select("node", "sig").mapInArrow(lambda it: _rows(it, lambda batch: _keyed(batch, n_bands, n_rows)), "node binary, keys array<long>").select("node", F.explode("keys").alias("key"))
    pivots = bands.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("most")).where("pivot <> most").drop("most")
    ties = stored(bands.join(pivots, "key").where("node <> pivot").select("key", F.col("node").alias("u"), F.col("pivot").alias("v")), "ties")

    def texts_of(asked: DataFrame) -> DataFrame:
        """asked(of, ...) with the texts of those ids and hashes; one of rows that repeat."""
        named = asked.select(F.col("of.doc_id").alias("of_id"), F.col("of.tkey").alias("of_key")).distinct()
        once = keyed.join(named, keyed.doc_id.eqNullSafe(named.of_id) & (keyed.tkey == named.of_key), "left_semi").dropDuplicates(["doc_id", "tkey"])
        return asked.join(once, F.col("of.doc_id").eqNullSafe(once.doc_id) & (F.col("of.tkey") == once.tkey)).drop("doc_id", "tkey", "of")

    # ties first: each class against the least of its buckets
    one = classes.select(F.col("node").alias("u"), F.col("n").alias("n_u"), "sig", F.col("of").alias("of_u"))
    two = classes.select(F.col("node").alias("v"), F.col("n").alias("n_v"), F.col("sig").alias("other"), F.col("of").alias("of_v"))
    sized = ties.select("u", "v").distinct().join(one, "u").join(two, "v").where(100 * F.least("n_u", "n_v") >= percent * F.greatest("n_u", "n_v"))
    pair = sized.select("u", "v", "sig", "other", "of_u", "of_v")
    alike = stored(pair.mapInArrow(lambda it: _rows(it, _agreeing(percent)), pair.select("u", "v", "of_u", "of_v").schema), "alike")
    large = alike.groupBy("v").agg(F.ceil(F.count("*") / TIED).cast("int").alias("copies")).where("copies > 1")
    salted = alike.join(large, "v", "left").withColumn("copy", F.when(F.col("copies").isNull(), 0).otherwise(F.pmod(F.xxhash64("u"), F.col("copies")).cast("int")))
    members = salted.select("v", "copy", F.lit(1).alias("role"), F.col("u").alias("node"), F.col("of_u").alias("of"))
    heads = salted.select("v", "copy", F.lit(0).alias("role"), F.col("v").alias("node"), F.col("of_v").alias("of")).distinct()
    met = texts_of(members.unionByName(heads)).select("v", "copy", "role", "node", "text")
    first = stored(met.repartition("v", "copy").sortWithinPartitions("v", "copy", "role").mapInArrow(_checked(percent), "u binary, v binary"), "links")

    # then what those leave apart in a bucket
    pieces_ = roots(first)
    label = pieces_.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    root = lambda side, name: label.select(F.col("node").alias(side), F.col("comp").alias(name))
    placed = ties.join(root("u", "cu"), "u", "left").join(root("v", "cv"), "v", "left")
    apart = placed.where(F.coalesce("cu", "u") != F.coalesce("cv", "v")).select("key").distinct()
    # a family's bucket is one key, which is dealt out over SALTS
    salted = ties.withColumn("salt", F.pmod(F.xxhash64("u"), F.lit(SALTS)).cast("int"))
    rest = roots(salted.join(apart.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["key", "salt"], "left_semi").select("u", "v").distinct())
    within = rest.select(F.col("u").alias("node"), F.col("v").alias("cluster")).unionByName(rest.select(F.col("v").alias("node"), F.col("v").alias("cluster")).distinct())
    within = within.join(classes.drop("hash"), "node").join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    counts = within.groupBy("cluster", "comp").agg(F.count("*").alias("c"))
    largest = counts.groupBy("cluster").agg(F.max(F.struct("c", "comp"))["comp"].alias("major"))
    within = stored(within.join(largest, "cluster").withColumn("minor", F.col("comp") != F.col("major")).drop("major"), "members")
    size = lambda some: F.greatest(F.ceil(F.count_if(some) / BLOCK_ROWS), F.ceil(F.coalesce(F.sum(F.when(some, F.col("n"))), F.lit(0)) / BLOCK_SHINGLES)).cast("int")
    # stored, so that the join has a shuffle on either side and a large cluster can be split
    sizes = stored(within.groupBy("cluster").agg(size(F.col("minor")).alias("minors"), size(~F.col("minor")).alias("majors")).where("minors > 0"), "clusters")
    asked = within.join(sizes, "cluster").select("node", "cluster", "comp", "minor", "minors", "majors", "sig", "of")
    sets = texts_of(asked).mapInArrow(lambda it: _rows(it, _with_sets), "node binary, cluster binary, comp binary, minor boolean, minors int, majors int, sig binary, shingles binary")
    block = F.when(F.col("minor"), F.pmod(F.xxhash64("node"), F.col("minors"))).otherwise(F.col("minors") + F.pmod(F.xxhash64("node"), F.col("majors"))).cast("int")
    others = F.sequence(F.lit(0), F.col("minors") - 1 + F.when(F.col("minor"), F.col("majors")).otherwise(F.lit(0)))
    own = sets.withColumn("block", block).withColumn("other", F.explode(others))
    blocks = own.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "sig", "shingles", "block", "comp")
    second = blocks.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "node").mapInArrow(_linked(percent), "u binary, v binary")
    links = roots(first.unionByName(second))
    named = classes.select("node", "hash", "of").join(links.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select(F.col("hash").alias("node"), _id_of(F.coalesce("root", "node")).alias("least"), F.when(F.col("root").isNull(), F.col("of")).alias("first"))
    component = F.coalesce("least", "doc_id")
    out = seen.select("doc_id", "tkey", "n_shingles", "node").join(named, "node", "left")
    drop_stored(ties, alike, first, pieces_, rest, within, sizes)
    # the class with the least name, which has no root, stands for its component
    chosen = F.col("node").isNull() | F.coalesce(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tkey") == F.col("first.tkey")), F.lit(False))
    return out.select("doc_id", "tkey", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), chosen.alias("chosen"))


def deduplicated(docs: DataFrame, percent: int = PERCENT, repeats: bool = True) -> DataFrame:
    """docs without the documents that are not kept. repeats: of rows with equal ids and of
    null ids all that are kept stay. Without, one row of each component stays: of equal ids
    one text's, a null id only where there is no other, and any of rows equal in both. Rows
    without shingles are linked with nothing and all stay."""
    judged = _judged(docs, percent)
    # the row goes along in one, so that no name can clash
    own = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("tkey"), F.struct(own_columns(docs)).alias("row"))

    def at(pairs: DataFrame, how: str) -> DataFrame:
        named = pairs.select(F.col("doc_id").alias("i"), F.col("tkey").alias("t"))
        return own.join(named, own.id.eqNullSafe(named.i) & (own.tkey == named.t), how)

    if repeats:
        return at(judged.where("not kept").select("doc_id", "tkey").distinct(), "left_anti").select("row.*")
    # stored, as it is read twice; texts are shuffled only of what is there more than once
    pairs = judged.groupBy("doc_id", "tkey").agg(F.bool_and("chosen").alias("chosen"), (F.bool_and(F.col("n_shingles") > 0) & (F.count("*") > 1)).alias("more"))
    odd = stored(pairs.where("not chosen or more"), "repeats")
    alone = at(odd, "left_anti")
    one = at(odd.where("chosen"), "left_semi").dropDuplicates(["id", "tkey"])
    return alone.unionByName(one).select("row.*")
