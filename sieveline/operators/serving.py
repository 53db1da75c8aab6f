"""What serving needs around a search: pages, unique look-ups, binary boundaries, searches
over an index with changes, deadlines, and a gate between searches and rebuilds."""

from __future__ import annotations

import threading
import uuid
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..request import SearchRequest
from ..sources.index import Index
from . import freshness, search


def page(found: DataFrame, size: int, after: tuple[str, int] | None = None) -> DataFrame:
    """The next `size` lines after (path, line_no), and one more as the sign that there are
    further ones: `is_more`. A later page costs no more than the first."""
    key = F.encode("path", "UTF-16BE")
    if after is not None:
        path, line = F.encode(F.lit(after[0]), "UTF-16BE"), F.lit(after[1])
        found = found.where((key > path) | ((key == path) & (F.col("line_no") > line)))
    first = search.in_order(found).limit(size + 1)
    return first.withColumn("is_more", F.row_number().over(Window.orderBy(key, "line_no")) > size)


def looked_up(paths: DataFrame, files: DataFrame) -> DataFrame:
    """The file of each path; `n_files` is 0 for a path that has none and over 1 for one
    that isn't unique, and a caller is to refuse both."""
    n = files.groupBy("path").agg(F.count("*").alias("n_files"), F.min("file_id").alias("file_id"))
    return paths.select("path").distinct().join(n, "path", "left").select("path", "file_id", F.coalesce("n_files", F.lit(0)).cast("long").alias("n_files"))


def before_nul(occurrences: DataFrame, files: DataFrame) -> DataFrame:
    """Occurrences that begin before their file's first NUL, if it has one: files(path,
    first_nul)."""
    return occurrences.join(files.select("path", "first_nul"), "path").where(F.col("first_nul").isNull() | (F.col("abs_start") < F.col("first_nul"))).drop("first_nul")


def spent(attempts: DataFrame, by: str) -> DataFrame:
    """Milliseconds of each stage over all attempts of attempts(by, stage, ms)."""
    return attempts.groupBy(by, "stage").agg(F.sum("ms").alias("ms"), F.count("*").alias("attempts"))


def search_current(request: SearchRequest, index: Index, changed: DataFrame, dirty: DataFrame) -> DataFrame:
    """Matches as of now: the index's, but for dirty files, and those of a scan of the
    changed files (file_id, path, text). What is dirty is a small part of the files."""
    old = search.search(request, index).found.join(dirty.select("path"), "path", "left_anti")
    live = changed.join(dirty.where("NOT tombstone").select("path"), "path", "left_semi")
    return old.unionByName(search.matches(live, request))


def recovered(files: DataFrame, dirty: DataFrame, changed: DataFrame) -> Index:
    """An index of the files as they are, which isn't written anywhere."""
    return Index.in_memory(freshness.current_files(files, changed, dirty))


class DeadlinePassed(TimeoutError):
    pass


def within(spark, seconds: float, action):
    """action(), whose jobs are cancelled when the time is over."""
    tag, over = f"sieveline-{uuid.uuid4().hex}", threading.Event()

    def stop():
        over.set()
        spark.sparkContext.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    spark.sparkContext.addJobTag(tag)
    timer.start()
    try:
        return action()
    except Exception as why:
        if over.is_set():
            raise DeadlinePassed(f"not done after {seconds} s") from why
        raise
    finally:
        timer.cancel()
        spark.sparkContext.removeJobTag(tag)


@dataclass
class _State:
    readers: int = 0
    waiting: int = 0
    writing: bool = False


class Gate:
    """Searches go on together; a rebuild waits for them and they wait for it. A waiting
    rebuild goes before searches that come later."""

    def __init__(self):
        self._state, self._turn = _State(), threading.Condition()

    @contextmanager
    def reading(self):
        with self._turn:
            self._turn.wait_for(lambda: not self._state.writing and not self._state.waiting)
            self._state.readers += 1
        try:
            yield
        finally:
            with self._turn:
                self._state.readers -= 1
                self._turn.notify_all()

    @contextmanager
    def writing(self):
        with self._turn:
            self._state.waiting += 1
            try:
                self._turn.wait_for(lambda: not self._state.writing and not self._state.readers)
            finally:
                self._state.waiting -= 1
            self._state.writing = True
        try:
            yield
        finally:
            with self._turn:
                self._state.writing = False
                self._turn.notify_all()
