"""What a query does to larger tables: steps whose number or size must not grow with them."""

import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sieveline import edge_queries, queries
from sieveline.sources import index
from sieveline.streaming import changes


def test_a_larger_feed_is_taken_in_no_more_batches(spark, tmp_path, monkeypatch):
    events = spark.range(40_000).select(F.col("id").alias("event_id"), (F.col("id") % 90).alias("user_id"), F.when(F.col("id") % 7 == 0, "error").otherwise("view").alias("event_type"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    tables, make = [], changes.DirtyTable
    monkeypatch.setattr(changes, "DirtyTable", lambda *args: tables.append(make(*args)) or tables[-1])
    rows = {tuple(r) for r in queries.dirty_stream(spark, str(tmp_path)).collect()}
    assert rows == {tuple(r) for r in queries.dirty_set(spark, str(tmp_path)).collect()} and len(rows) == 90
    assert 1 < tables[0].state()["batch"] + 1 <= queries.BATCHES


TEXTS = ["", "ab", "abc abcd", None, "K abc\u212a", "x\u017fyz", "abab" * 9, "\u00e9abc\U0001f600_9Z", "no\nabc", "a"]


def _plain(rows) -> dict:
    out = {}
    for i, part, text in rows:
        grams = set(re.findall("(?=([A-Za-z0-9_]{3}))", text or "")) | ({index.FOLDED_LETTERS} if re.search(f"[{index.FOLDED_LETTERS}]", text or "") else set())
        for g in grams:
            out.setdefault((g, part), []).append(i)
    return {k: sorted(v) for k, v in out.items()}


def test_posting_lists_make_no_row_for_a_posting(spark):
    rows = [(i * 7 % 31, 0, t) for i, t in enumerate(TEXTS * 3)]
    lists = index.posting_lists(spark.createDataFrame(rows, "file_id long, part int, text string").coalesce(1))
    assert {(r.gram, r.part): r.ids for r in lists.collect()} == _plain(rows)
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Generate", "Aggregate", "Sort"))


@pytest.mark.parametrize("step", [3, 5, 4 << 20])
@pytest.mark.parametrize("held", [0, 9, 4 << 20])
def test_posting_lists_in_small_steps(monkeypatch, step, held):
    monkeypatch.setattr(index, "STEP_BYTES", step)
    monkeypatch.setattr(index, "HELD_POSTINGS", held)
    rows = [(i * 7 % 41, i // 13, t) for i, t in enumerate(TEXTS * 4)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int32(), pa.string()))], ["file_id", "part", "text"])
    got = {}
    for out in index._listed([batch[:17], batch[17:]]):
        for r in out.to_pylist():
            assert r["ids"] == sorted(r["ids"])
            got.setdefault((r["gram"], r["part"]), []).extend(r["ids"])
    assert {k: sorted(v) for k, v in got.items()} == _plain(rows)


def test_letters_are_counted_within_parts(spark, tmp_path):
    files = spark.createDataFrame([(i, f"p/{i}", t or "") for i, t in enumerate(TEXTS * 3)], "file_id long, path string, text string")
    own = index.write(files, f"file://{tmp_path}/index", part_bytes=1)
    letters, want = edge_queries.letters(own), {}
    for gram, i in own.postings.collect():
        want.setdefault(gram[0], []).append(i)
    assert {r.letter: (r.n, r.n_files) for r in letters.collect()} == {k: (len(v), len(set(v))) for k, v in want.items()}
    plan = letters._jdf.queryExecution().executedPlan().toString()
    assert len(own.parts) > 1 and re.search(rf"hashpartitioning\(letter#\d+, part#\d+, {edge_queries.TASKS_A_PART * len(own.parts)}\)", plan)
    # no task groups files before they are dealt out
    assert not re.search(r"hashpartitioning\([^)]*file_id", plan)
