"""Connected components of links between any orderable values.

Up to LOCAL links, a measured number, are resolved in one task of bounded memory. Beyond
it, alternating large-star and small-star steps run until nothing changes: every step is
an aggregation with map-side minimum and a join that adaptive execution can split, so a
node with very many links is no single task's. Links never reach the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, lean, stored

LOCAL = 1_000_000


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


@lean
def _resolve(batches):
    """All links of the task: each node but the least of its component, with that."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    n = t.num_rows
    coded = pa.concat_arrays([t.column("u").combine_chunks(), t.column("v").combine_chunks()]).dictionary_encode()
    order = np.asarray(pc.sort_indices(coded.dictionary))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    ends = rank[np.asarray(coded.indices)]
    a, b = ends[:n], ends[n:]
    root = np.arange(len(order))
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        for x in (a, b, root[a], root[b]):
            np.minimum.at(new, x, least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    which = np.flatnonzero(root != np.arange(len(root)))
    for i in range(0, len(which), 50_000):
        w = which[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(order[w])), coded.dictionary.take(pa.array(order[root[w]]))], ["u", "v"])


def roots(links: DataFrame, local: int = LOCAL) -> DataFrame:
    """links(u, v), in either direction, with repeats: u, v with a row for each node
    besides the least of its component, v being that least node. No links give no rows;
    links from a node to itself, and nulls, are ignored."""
    at = stored(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before, now = None, at.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    if now[0] <= local:
        if now[0]:
            at, old = stored(at.coalesce(1).mapInArrow(_resolve, at.schema), "links"), at
            drop_stored(old)
        return at
    while now != before:
        before = now
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        least = _least(large)
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        at, old = stored(small, "links"), at
        drop_stored(old)
        now = at.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return at
