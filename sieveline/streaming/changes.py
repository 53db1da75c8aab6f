"""Change feeds as streams: each batch of events becomes part of the dirty set, kept as
generations of a small Parquet table, and the overlay of changed files follows it.

A batch that comes again after a failure changes nothing: a path's state is its greatest
generation, and the state's folder is named by the batch.
"""

from __future__ import annotations

import json
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.freshness import acknowledged, dirty_paths
from ..sources.index import file_system, get_text, names, put_text

EVENT = "path string, generation long, tombstone boolean"
STATE, COMPACT = r"state-(\d+)\.json", 16
#: Paths whose change means that another state of the repository was taken up.
HEADS = r"^\.git/(HEAD|packed-refs|refs/.*)$"


def dirty_stream(events: DataFrame) -> DataFrame:
    """The last event of each path, as a streaming aggregation for update or complete
    output."""
    return dirty_paths(events)


class DirtyTable:
    """The dirty set in a folder of shared storage: a base and the batches since, of which each
    holds its paths' last events; a read takes the greatest of each path. A batch writes its own
    paths only; after COMPACT of them all is written as a new base. Every change makes a numbered
    state, which names its folders; the greatest one counts. Folders that neither it nor the one
    before names are deleted, so that a read that has begun finds what it named."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def state(self) -> dict:
        found = names(self.spark, self.folder, STATE)
        return json.loads(get_text(self.spark, f"{self.folder}/{found[-1][1]}")) if found else {"at": [], "batch": -1, "generation": 0, "trusted": True, "head": None, "overlay": None, "version": 0}

    def read(self) -> DataFrame:
        """One generation: paths, tombstones and their numbers as one state has them."""
        return self._of(self.state())

    def _of(self, state: dict) -> DataFrame:
        if not state["at"]:
            return self.spark.createDataFrame([], EVENT)
        every = self.spark.read.schema(EVENT).parquet(*(f"{self.folder}/{x}" for x in state["at"]))
        return every if len(state["at"]) == 1 else dirty_paths(every)

    def _put(self, old: dict, **changes) -> None:
        new = old | {"version": old["version"] + 1} | changes
        put_text(self.spark, f"{self.folder}/state-{new['version']}.json", json.dumps(new))
        fs, at = file_system(self.spark, self.folder)
        named = {*old["at"], *new["at"]}
        for _, name in names(self.spark, self.folder, r"v=(\d+)"):
            if name not in named:
                fs.delete(file_system(self.spark, f"{self.folder}/{name}")[1], True)
        for n, name in names(self.spark, self.folder, STATE):
            if n < new["version"] - 1:
                fs.delete(file_system(self.spark, f"{self.folder}/{name}")[1], True)

    def _write(self, dirty: DataFrame, old: dict) -> str:
        name = f"v={old['version'] + 1}"
        dirty.select("path", "generation", "tombstone").write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return name

    def mark(self, events: DataFrame, batch: int | None = None) -> None:
        """Adds events. A null path says that anything may have changed; one of HEADS, that all
        may have: the snapshot that an index was built of is no more."""
        now = self.state()
        if batch is not None and batch <= now["batch"]:
            return
        unknown, head, last = events.agg(F.count_if(F.col("path").isNull()), F.max(F.when(F.col("path").rlike(HEADS), F.col("generation"))), F.max("generation")).first()
        changes = {"batch": now["batch"] if batch is None else batch, "generation": max(now["generation"], last or 0), "trusted": now["trusted"] and not unknown, "head": max(now["head"] or 0, head) if head is not None else now["head"]}
        if len(now["at"]) < COMPACT:
            self._put(now, at=[*now["at"], self._write(dirty_paths(events), now)], **changes)
        else:
            both = self._of(now).unionByName(events.select("path", "generation", "tombstone"))
            self._put(now, at=[self._write(dirty_paths(both), now)], **changes)

    def acknowledge(self, paths: DataFrame, snapshot_generation: int) -> None:
        if snapshot_generation >= 0:
            now = self.state()
            self._put(now, at=[self._write(acknowledged(self._of(now), paths, snapshot_generation), now)], generation=now["generation"] + 1)

    def trust(self) -> None:
        """After a full listing, coverage is known again."""
        self._put(self.state(), trusted=True, head=None)

    def distrust(self) -> str | None:
        """Why a search may not rely on an index and these changes."""
        now = self.state()
        return None if now["trusted"] and now["head"] is None else "coverage_untrusted" if not now["trusted"] else "snapshot_changed"

    def build_overlay(self, files: DataFrame) -> str:
        """Writes the changed files' present contents, of files(file_id, path, text), and makes
        them the overlay in use, with the generation that they are of; a read sees the one
        before until then."""
        now = self.state()
        live = files.join(self._of(now).where("NOT tombstone").select("path"), "path", "left_semi")
        name = f"overlay={now['version'] + 1}"
        live.select("file_id", "path", "text").write.mode("overwrite").parquet(f"{self.folder}/{name}")
        self._put(now, overlay={"at": name, "generation": now["generation"]})
        for _, other in names(self.spark, self.folder, r"overlay=(\d+)"):
            if other not in (name, (now["overlay"] or {}).get("at")):
                file_system(self.spark, self.folder)[0].delete(file_system(self.spark, f"{self.folder}/{other}")[1], True)
        return name

    def overlay(self) -> tuple[DataFrame | None, int]:
        """The overlay in use and the generation that it is of."""
        own = self.state()["overlay"]
        return (self.spark.read.parquet(f"{self.folder}/{own['at']}"), own["generation"]) if own else (None, 0)


def follow(events: DataFrame, table: DirtyTable, checkpoint: str, after=None, quiet_seconds: float | None = None, **trigger):
    """Starts a query that keeps the dirty table up with a stream of events; `after` is
    called with the table at the end of each batch, as to build an overlay. quiet_seconds: call
    it only when so long no batch with events has come, once for all that came before. trigger:
    as for DataStreamWriter.trigger; without one, what is there is taken and the query ends."""
    timer: list[threading.Timer] = []

    def rested():
        after(table)

    def each(batch: DataFrame, number: int) -> None:
        table.mark(batch, number)
        if after is None:
            return
        if quiet_seconds is None:
            after(table)
            return
        for old in timer:
            old.cancel()
        timer[:] = [threading.Timer(quiet_seconds, rested)]
        timer[0].daemon = True
        timer[0].start()

    writer = events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
