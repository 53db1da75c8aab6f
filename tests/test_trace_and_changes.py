import pytest
from pyspark.sql import functions as F

from sieveline.operators import freshness, trace
from sieveline.streaming import changes


def test_gaps_are_the_complement_of_the_union(spark):
    spans = spark.createDataFrame([("r", 2.0, 5.0), ("r", 4.0, 6.0), ("r", 8.0, 9.0), ("q", 0.0, 10.0)], "run_id string, start_ms double, end_ms double")
    total = spark.createDataFrame([("r", 10.0), ("q", 10.0), ("none", 3.0)], "run_id string, total_ms double")
    got = sorted((r.run_id, r.start_ms, r.end_ms) for r in trace.gaps(spans, total).collect())
    assert got == [("none", 0.0, 3.0), ("r", 0.0, 2.0), ("r", 6.0, 8.0), ("r", 9.0, 10.0)]
    assert sorted((r.run_id, r.start_ms, r.end_ms) for r in trace.islands(spans).collect()) == [("q", 0.0, 10.0), ("r", 2.0, 6.0), ("r", 8.0, 9.0)]
    assert trace.gaps(spans.limit(0), total.limit(0)).count() == 0


def test_pairing(spark):
    rows = [
        ("r", "a", "grep", "start", 1.0, False), ("r", "a", "grep", "end", 3.0, True), ("r", "b", "read", "start", 2.0, False), ("r", "c", "read", "end", 4.0, False),
        ("r", "d", "ls", "start", 1.0, False), ("r", "d", "ls", "start", 2.0, False), ("r", "e", "ls", "start", 1.0, False), ("r", "e", "bash", "end", 2.0, False), ("r", "f", "web", "start", 5.0, False), ("r", "f", "web", "end", 6.0, False),
    ]
    marks = spark.createDataFrame(rows, "run_id string, tool_call_id string, tool string, phase string, at_ms double, is_error boolean")
    total = spark.createDataFrame([("r", 9.0)], "run_id string, total_ms double")
    got = {r.tool_call_id: r for r in trace.paired(marks, total).collect()}
    assert (got["a"].op, got["a"].duration_ms, got["a"].status, got["a"].problem) == ("grep", 2.0, "error", None)
    assert (got["b"].end_ms, got["b"].status) == (9.0, "aborted") and got["f"].op == "tool"
    assert {k: got[k].problem for k in "cde"} == {"c": "orphan_end", "d": "duplicate_start", "e": "tool_mismatch"}


def test_usage_and_latency(spark):
    schema = "run_id string, input double, output double, cache_read double, cache_write double, reasoning double, total_tokens double, cost_total double"
    rows = [("r", 10.0, 5.0, 1.0, 0.0, None, 0.0, None), ("r", 1.0, -2.0, None, 0.0, 3.0, 50.0, None)]
    got = trace.usage(spark.createDataFrame(rows, schema)).first()
    assert (got.input, got.output, got.cache_read, got.total_tokens, got.reasoning, got.cost_total) == (11.0, 5.0, 1.0, 66.0, 3.0, None)
    values = spark.createDataFrame([("q", v) for v in (1.0, 2.0, 4.0, 8.0)], "k string, v double")
    got = trace.latency(values, "k", "v").first()
    assert (got.n, got.min_ms, got.max_ms, got.mean_ms, got.p50_ms) == (4, 1.0, 8.0, 3.75, 3.0)
    assert abs(got.p95_ms - 7.4) < 1e-9


def test_redaction(spark):
    df = spark.createDataFrame([({"pattern": "secret", "path": "a/b"}, "/work/repo/a/b"), ({"z": None}, "/etc/passwd")], "a map<string,string>, p string")
    first, second = df.select(trace.signature(F.col("a")).alias("s"), trace.repository_path(F.col("p"), "/work/repo").alias("p")).collect()
    assert first.s.argument_keys == ["path", "pattern"] and len(first.s.pattern_hash) == 64 and first.p == "<repo>/a/b"
    assert second.s.pattern_hash is None and second.p.startswith("<external:") and "etc" not in second.p


def test_runs_from_json(spark, tmp_path):
    good = '{"run_id":"r","attempt":1,"prompt_hash":"' + "a" * 64 + '","total_ms":5.0,"events":[{"op":"grep","start_ms":1.0,"end_ms":2.0}]}'
    bad = '{"run_id":"s","attempt":0,"prompt_hash":"x","total_ms":5.0,"events":[]}'
    (tmp_path / "runs.json").write_text(good + "\n" + bad + "\n")
    runs = trace.read_runs(spark, f"file://{tmp_path}/runs.json")
    assert {r.run_id: r.invalid for r in runs.collect()} == {"r": None, "s": "attempt"}
    assert [(r.run_id, r.op) for r in trace.trace_events(runs).collect()] == [("r", "grep")]


EVENTS = [("a", 1, False), ("b", 2, False), ("a", 3, True), (".git/x", 4, False), ("../out", 5, False), ("c", 6, False)]


def test_dirty_sets(spark):
    dirty = freshness.dirty_paths(spark.createDataFrame(EVENTS, changes.EVENT))
    assert {r.path: (r.generation, r.tombstone) for r in dirty.collect()} == {"a": (3, True), "b": (2, False), "c": (6, False)}
    paths = dirty.select("path")
    assert {r.path for r in freshness.acknowledged(dirty, paths, 2).collect()} == {"a", "c"}
    base = spark.createDataFrame([("a", "old"), ("b", "old"), ("d", "old")], "path string, text string")
    overlay = spark.createDataFrame([("a", "new"), ("b", "new"), ("c", "new"), ("d", "unused")], "path string, text string")
    assert {(r.path, r.text) for r in freshness.current_files(base, overlay, dirty).collect()} == {("b", "new"), ("c", "new"), ("d", "old")}
    listed = spark.createDataFrame([("d", False)], "path string, tombstone boolean")
    assert {r.path for r in freshness.merged_with(dirty, listed, 5, 7, replace=True).collect()} == {"c", "d"}
    assert {r.path for r in freshness.merged_with(dirty, listed, 5, 7).collect()} == {"a", "b", "c", "d"}


def test_fences():
    F1, F2 = freshness.Fence(1, 1), freshness.Fence(2, 1)
    assert freshness.guarded(lambda: "rows", lambda: F1, lambda why: why) == ("rows", None)
    seen = iter([F1, F2])
    assert freshness.guarded(lambda: "rows", lambda: next(seen), lambda why: f"scan: {why}") == ("scan: files_changed", "files_changed")
    assert freshness.broken(F1, freshness.Fence(1, 2)) == "index_changed" and freshness.broken(F1, freshness.Fence(1, 1, trusted=False)) == "coverage_untrusted"


def test_streams(spark, tmp_path):
    for i, part in enumerate((EVENTS[:3], EVENTS[3:])):
        spark.createDataFrame(part, changes.EVENT).coalesce(1).write.parquet(f"file://{tmp_path}/feed/{i}")
    events = spark.readStream.schema(changes.EVENT).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/feed/*")
    table, seen = changes.DirtyTable(spark, f"file://{tmp_path}/table"), []
    changes.follow(events, table, f"file://{tmp_path}/checkpoint", after=lambda t: seen.append(t.state()["generation"])).awaitTermination()
    assert {r.path: r.generation for r in table.read().collect()} == {"a": 3, "b": 2, "c": 6} and seen[-1] == 6 and len(seen) == 2
    table.mark(spark.createDataFrame([("zzz", 9, False)], changes.EVENT), batch=1)  # seen before
    assert table.read().where("path = 'zzz'").count() == 0
    table.acknowledge(table.read(), 3)
    assert [r.path for r in table.read().collect()] == ["c"]
    table.mark(spark.createDataFrame([(None, 11, False)], changes.EVENT))
    assert not table.state()["trusted"]
    table.trust()
    assert table.state()["trusted"]
    query = changes.dirty_stream(events).writeStream.format("memory").queryName("dirty").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("dirty").count() == 3


def test_the_entry_needs_no_training_data_operators(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{top}/sieveline", tmp_path / "sieveline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{top}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)


@pytest.mark.parametrize(("glob", "yes", "no"), [
    ("*.ts", ["a.ts", "x/y/a.ts"], ["a.tsx", "a.ts/b"]), ("src/*.ts", ["src/a.ts"], ["src/x/a.ts", "y/src/a.ts"]), ("src/**/*.ts", ["src/a.ts", "src/x/y/a.ts"], ["srcx/a.ts"]), ("**/t/*.ts", ["t/a.ts", "x/t/a.ts"], ["xt/a.ts"]),
    ("a?c.[xy]", ["abc.x"], ["ac.x", "abc.z", "a/c.x"]), ("*.{js,ts}", ["q.js", "p/q.ts"], ["q.jsx"]), ("src/**", ["src/a", "src/b/c"], ["srcs/a"]), ("[!a]b", ["cb", "x/cb"], ["ab"]),
    ("{src/a,lib}/*.ts", ["src/a/x.ts", "lib/x.ts"], ["src/x.ts", "src/a/b/x.ts"]), ("*.{ts,{js,tsx}}", ["a.ts", "b/a.js", "a.tsx"], ["a.jsx"]), ("{a,b/c}.x", ["a.x", "q/a.x", "b/c.x"], ["q/b/c.x"]), ("a{b", ["a{b"], ["ab"]), ("[{]x", ["{x"], ["x"]),
])
def test_globs(glob, yes, no):
    import re

    from sieveline.functions import globs

    pattern = re.compile(globs.to_regex(glob))
    assert all(pattern.search(p) for p in yes) and not any(pattern.search(p) for p in no)


def test_simple_globs():
    from sieveline.functions import globs

    assert all(map(globs.simple, ("*.ts", "a/**/b", "**/x", "a*b/c")))
    assert not any(map(globs.simple, ("", "/a", "a/", "a/**", "**/**/a", "a**b", "!a", "a?", "[a]", "{a}", "a\\b", "./a")))
    assert globs.mandatory_literals("src/*.ts") == ["src", ".ts"] and globs.mandatory_literals("!x.ts") == []


def test_mandatory_grams():
    from sieveline.functions.regexes import mandatory_grams, parse, pure_literal

    grams = lambda p, i=False: {g.decode() for g in mandatory_grams(parse(p, i))}
    assert grams("abcd") == {"abc", "bcd"} and grams("abc|abcd") == {"abc"} and grams("(abc)+x") == {"abc"} and grams("(abc)*") == set()
    assert grams("abc.def") == {"abc", "def"} and grams("ab[c]d") == set() and grams("abc", True) == set() and grams("^foo_bar$") == {"foo", "oo_", "o_b", "_ba", "bar"}
    assert pure_literal(r"^import\.meta$") == "import.meta" and pure_literal("a.b") is None


def test_a_feed_keeps_batches_apart_until_it_compacts(spark, tmp_path):
    import os

    table, want = changes.DirtyTable(spark, f"file://{tmp_path}/table"), {}
    for n in range(changes.COMPACT + 4):
        events = [(f"p{n % 5}", n, n % 3 == 0), (f"q{n}", n, False)]
        want |= {p: (g, t) for p, g, t in events}
        table.mark(spark.createDataFrame(events, changes.EVENT).coalesce(1), batch=n)
        assert len(table.state()["at"]) <= changes.COMPACT
    assert {r.path: (r.generation, r.tombstone) for r in table.read().collect()} == want
    names = [x for x in os.listdir(tmp_path / "table") if x.startswith("v=")]
    assert len(names) <= changes.COMPACT + 1, "folders that no state names are gone"
    assert sum(x.startswith("state-") and x.endswith(".json") for x in os.listdir(tmp_path / "table")) <= 2


def test_overlays_follow_the_feed_and_distrust_stops_the_index(spark, tmp_path):
    from sieveline.operators import search
    from sieveline.request import SearchRequest
    from sieveline.sources.index import Index

    table = changes.DirtyTable(spark, f"file://{tmp_path}/table")
    files = spark.createDataFrame([(1, "a", "needle one"), (2, "b", "needle two")], "file_id long, path string, text string")
    assert table.overlay() == (None, 0) and table.distrust() is None
    table.mark(spark.createDataFrame([("a", 5, False), ("b", 6, True)], changes.EVENT))
    table.build_overlay(files)
    own, generation = table.overlay()
    assert [r.path for r in own.collect()] == ["a"] and generation == 6
    request, index = SearchRequest("needle", literal=True, limit=None), Index.in_memory(files)
    assert search.search(request, index, files, distrust=table.distrust()).plan.route == "index"
    table.mark(spark.createDataFrame([(".git/HEAD", 7, False)], changes.EVENT))
    got = search.search(request, index, files, distrust=table.distrust())
    assert (got.plan.route, got.plan.reason) == ("scan", "snapshot_changed") and got.found.count() == 2
    with pytest.raises(search.StaleIndex):
        search.search(request, index, distrust=table.distrust())
    table.mark(spark.createDataFrame([(None, 8, False)], changes.EVENT))
    assert table.distrust() == "coverage_untrusted"
    table.trust()
    assert table.distrust() is None


def test_quiet_feeds_call_once(spark, tmp_path):
    import time

    for i, part in enumerate((EVENTS[:3], EVENTS[3:])):
        spark.createDataFrame(part, changes.EVENT).coalesce(1).write.parquet(f"file://{tmp_path}/feed/{i}")
    events = spark.readStream.schema(changes.EVENT).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/feed/*")
    table, seen = changes.DirtyTable(spark, f"file://{tmp_path}/table"), []
    changes.follow(events, table, f"file://{tmp_path}/checkpoint", after=lambda t: seen.append(t.state()["generation"]), quiet_seconds=6.0).awaitTermination()
    end = time.time() + 30
    while not seen and time.time() < end:
        time.sleep(0.2)
    assert seen == [6]


def test_ignore_files_on_the_way_down(spark):
    from sieveline.sources import corpus

    rows = [(".gitignore", "# all\n*.log\n/build/\n\nsub/x.txt\n"), ("keep/.gitignore", "!*.log\n"), ("a.log", ""), ("keep/a.log", ""), ("keep/deep/a.log", ""), ("build/a", ""), ("q/build/a", ""), ("sub/x.txt", ""), ("q/sub/x.txt", "")]
    files = spark.createDataFrame(rows, "path string, text string")
    marked = corpus.mark_ignored(files, corpus.ignore_rules(files))
    assert {r.path for r in marked.where("ignored").collect()} == {"a.log", "build/a", "sub/x.txt"}
