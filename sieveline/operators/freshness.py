"""Changes over an index: dirty paths with generations, acknowledgement, overlays, fences.

events: path, generation, tombstone; each change has a generation of its own, which only
grows. dirty: the last event of each path.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import globs


def dirty_paths(events: DataFrame) -> DataFrame:
    """path, generation, tombstone of each path's last event. Paths that no search looks
    at are left out."""
    seen = events.where(F.col("path").isNotNull() & (F.col("path") != "") & ~F.col("path").startswith("../") & ~globs.left_out(F.col("path")))
    return seen.groupBy("path").agg(F.max("generation").alias("generation"), F.max_by("tombstone", "generation").alias("tombstone"))


def acknowledged(dirty: DataFrame, paths: DataFrame, snapshot_generation: int) -> DataFrame:
    """dirty without those of `paths` whose last event the snapshot has seen; a later
    event outlives the acknowledgement."""
    done = paths.select("path").distinct().withColumn("done", F.lit(True))
    kept = dirty.join(done, "path", "left").where(F.col("done").isNull() | (F.col("generation") > snapshot_generation))
    return kept.drop("done")


def merged_with(dirty: DataFrame, found: DataFrame, started_at: int, generation: int, replace: bool = False) -> DataFrame:
    """dirty with what a listing of changes has found (path, tombstone). With replace,
    older paths go that the listing hasn't, but not those changed since it started."""
    listed = found.select("path", F.lit(generation).cast("long").alias("generation"), "tombstone")
    old = dirty.where(F.col("generation") > started_at) if replace else dirty
    return old.select("path", "generation", "tombstone").unionByName(listed).groupBy("path").agg(F.max("generation").alias("generation"), F.max_by("tombstone", "generation").alias("tombstone"))


def current_files(base: DataFrame, overlay: DataFrame, dirty: DataFrame) -> DataFrame:
    """The base's files without dirty ones, and the overlay's for those that still are."""
    kept = base.join(dirty.select("path"), "path", "left_anti")
    live = overlay.join(dirty.where("NOT tombstone").select("path"), "path", "left_semi")
    return kept.unionByName(live.select(kept.columns))


def current_matches(base: DataFrame, overlay: DataFrame, dirty: DataFrame) -> DataFrame:
    """The same for matches: those of the index in files that are not dirty, and those of
    a scan of the changed files."""
    return current_files(base, overlay, dirty)


@dataclass(frozen=True)
class Fence:
    """What must not change while a query runs."""

    generation: int
    index_generation: int
    snapshot: str = ""
    trusted: bool = True


def broken(before: Fence, after: Fence) -> str | None:
    """Why a query's result may not be used; None if it may."""
    if not (before.trusted and after.trusted):
        return "coverage_untrusted"
    if before.index_generation != after.index_generation:
        return "index_changed"
    if before.snapshot != after.snapshot:
        return "snapshot_changed"
    if before.generation != after.generation:
        return "files_changed"
    return None


def guarded(search, fence, fallback):
    """search() if fence() is the same before and after, else fallback(reason)."""
    before = fence()
    out = search()
    reason = broken(before, fence())
    return (out, None) if reason is None else (fallback(reason), reason)
