import threading
import time

import pytest

from sieveline.operators import search, serving
from sieveline.request import SearchRequest
from sieveline.sources.index import Index

FILES = "file_id long, path string, text string"


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(1, "a", "hit 1\nx\nhit 2\n"), (2, "b", "hit 3\n"), (3, "c", "hit 4")], FILES).cache()


def request(limit=None):
    return SearchRequest("hit", literal=True, limit=limit)


def test_pages(files):
    found = search.search(request(), files=files).found
    seen, after = [], None
    while True:
        rows = serving.page(found, 3, after).collect()
        seen += [(r.path, r.line_no) for r in rows if not r.is_more]
        if not rows or not rows[-1].is_more:
            break
        after = seen[-1]
    assert seen == [("a", 1), ("a", 3), ("b", 1), ("c", 1)]


def test_look_ups_and_boundaries(spark, files):
    paths = spark.createDataFrame([("a",), ("zz",), ("a",)], "path string")
    assert {(r.path, r.n_files) for r in serving.looked_up(paths, files.union(files.where("path = 'a'"))).collect()} == {("a", 2), ("zz", 0)}
    spots = spark.createDataFrame([("a", 5, 7), ("a", 15, 17), ("b", 1, 2)], "path string, abs_start long, abs_end long")
    flags = spark.createDataFrame([("a", 10), ("b", None)], "path string, first_nul long")
    assert {(r.path, r.abs_start) for r in serving.before_nul(spots, flags).collect()} == {("a", 5), ("b", 1)}
    spent = serving.spent(spark.createDataFrame([("q", "scan", 2.0), ("q", "scan", 3.0)], "q string, stage string, ms double"), "q").first()
    assert (spent.ms, spent.attempts) == (5.0, 2)


def test_changes_over_an_index(spark, files):
    dirty = spark.createDataFrame([("a", 4, False), ("b", 5, True), ("d", 6, False)], "path string, generation long, tombstone boolean")
    changed = spark.createDataFrame([(1, "a", "no\nhit new\n"), (4, "d", "hit d"), (2, "b", "hit gone")], FILES)
    want = {("a", 2), ("c", 1), ("d", 1)}
    now = serving.search_current(request(), Index.in_memory(files), changed, dirty)
    assert {(r.path, r.line_no) for r in now.collect()} == want
    rebuilt = search.search(request(), serving.recovered(files, dirty, changed))
    assert {(r.path, r.line_no) for r in rebuilt.matches.collect()} == want


def test_deadlines(spark):
    assert serving.within(spark, 60, lambda: spark.range(5).count()) == 5
    with pytest.raises(serving.DeadlinePassed):
        serving.within(spark, 1, lambda: spark.range(10**12).selectExpr("sum(sqrt(id))").collect())
    with pytest.raises(ZeroDivisionError):
        serving.within(spark, 60, lambda: 1 // 0)


def test_gate():
    gate, log = serving.Gate(), []

    def rebuild():
        with gate.writing():
            log.append("built")

    def late():
        with gate.reading():
            log.append("late")

    with gate.reading(), gate.reading():
        threads = [threading.Thread(target=rebuild)]
        threads[0].start()
        time.sleep(0.2)
        threads.append(threading.Thread(target=late))
        threads[1].start()
        time.sleep(0.2)
        assert log == []
    for t in threads:
        t.join(5)
    assert log == ["built", "late"]
