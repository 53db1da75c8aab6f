import random
import os
import re

import pytest
from pyspark.sql import functions as F

from sieveline.functions.regexes import InvalidRegex
from sieveline.operators import compare, present, search
from sieveline.plans import planner
from sieveline.request import SearchRequest
from sieveline.sources import corpus
from sieveline.sources.index import Index

ROWS = [
    ("src/main.ts", "export const A = 'RARE_TOKEN';\nconst Mixed_Value = 1; // MANY\nMANY MANY\nGLOB_T\nαβγ Ελλάδα\n"),
    ("src/helper.go", "package x\nMANY\nGLOB_T\n"),
    ("src/sub/nested.ts", "x\nGLOB_T PATH_T\n"),
    ("src/sub/deep/deeper.ts", "GLOB_T PATH_T"),
    ("src/sub-other/a.ts", "PATH_T"),
    ("context.txt", "CTX\nl2\nl3\nCTX\nl5\nl6\nl7\nl8\nl9\nCTX\n"),
    ("multiline.txt", "BEGIN\nline alpha\nline beta\nEND\n"),
    (".hidden/hidden.ts", "HIDDEN_T\n"),
    ("ignored/ignored.ts", "IGNORED_T\n"),
    (".hidden-ignored/both.ts", "HIDDEN_T IGNORED_T\n"),
    (".git/config", "RARE_TOKEN\n"),
    ("crlf.txt", "before\r\nTOKEN(one TOKEN(two\r\nafter\r\n"),
    ("a.txt", "aaaaa\n"),
    ("bare-cr.txt", "left\rbare-cr-hit\rright"),
    ("binary.bin", "binary-hit\x00tail RARE_TOKEN"),
    ("unicode.txt", "😀 café finish\nalpha ::: :::\nsnow 雪雪 end\n"),
    ("kelvin.txt", "300 \u212aelvin\nmi\u017fs\n"),
    ("empty.txt", ""),
    ("long.txt", "x" * 65535 + "TOKEN(boundary\n"),
    ("src/\ue000.txt", "ordering\n"),
    ("src/😀.txt", "ordering\n"),
    ("literal.txt", "a [x].* (b)\n\\E \\Q\n"),
]


@pytest.fixture(scope="module")
def files(spark):
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(ROWS)], "file_id long, path string, text string")
    return corpus.mark_ignored(df, ["ignored/", ".hidden-ignored/"]).cache()


@pytest.fixture(scope="module")
def index(files):
    own = Index.in_memory(files)
    own.postings.cache()
    own.grams.cache()
    return own


def request(pattern, literal=True, **more):
    return SearchRequest(pattern, literal=literal, **{"limit": None} | more)


def where(result):
    return [(r.path, r.line_no) for r in result.matches.collect()]


def run(files, index, *args, **more):
    """Both routes, which must agree."""
    scan, fast = search.search(request(*args, **more), files=files), search.search(request(*args, **more), index)
    rows = [r.asDict(True) for r in scan.matches.collect()]
    assert rows == [r.asDict(True) for r in fast.matches.collect()]
    return rows


def spots(rows):
    return [(r["path"], r["line_no"]) for r in rows]


def ranges(rows):
    return [(x["abs_start"], x["abs_end"]) for r in rows for x in r["ranges"]]


def test_literals_scopes_and_globs(files, index):
    assert spots(run(files, index, "RARE_TOKEN")) == [("src/main.ts", 1)]
    assert spots(run(files, index, "GLOB_T", glob="*.ts")) == [("src/main.ts", 4), ("src/sub/deep/deeper.ts", 1), ("src/sub/nested.ts", 2)]
    assert spots(run(files, index, "GLOB_T", glob="src/sub/**/*.ts")) == [("src/sub/deep/deeper.ts", 1), ("src/sub/nested.ts", 2)]
    assert spots(run(files, index, "PATH_T", path="src/sub")) == [("src/sub/deep/deeper.ts", 1), ("src/sub/nested.ts", 2)]
    assert spots(run(files, index, "PATH_T", path="src/sub/nested.ts")) == [("src/sub/nested.ts", 2)]
    assert spots(run(files, index, "GLOB_T", glob="!*.ts")) == [("src/helper.go", 3)]
    assert run(files, index, "mixed_value") == []
    assert spots(run(files, index, "mixed_value", ignore_case=True)) == [("src/main.ts", 2)]
    assert run(files, index, "ABSENT_TOKEN") == []
    assert spots(run(files, index, "[x].* (b)")) == [("literal.txt", 1)] and spots(run(files, index, "\\E \\Q")) == [("literal.txt", 2)]


def test_visibility(files, index):
    assert run(files, index, "HIDDEN_T") == []
    assert spots(run(files, index, "HIDDEN_T", hidden=True)) == [(".hidden/hidden.ts", 1)]
    assert run(files, index, "IGNORED_T") == []
    assert spots(run(files, index, "IGNORED_T", no_ignore=True)) == [("ignored/ignored.ts", 1)]
    assert spots(run(files, index, "IGNORED_T", no_ignore=True, hidden=True)) == [(".hidden-ignored/both.ts", 1), ("ignored/ignored.ts", 1)]


def test_byte_ranges(files, index):
    assert ranges(run(files, index, "aaa")) == [(0, 3)]
    assert ranges(run(files, index, ":::", path="unicode.txt")) == [(24, 27), (28, 31)]
    assert ranges(run(files, index, "finish")) == [(11, 17)]
    assert ranges(run(files, index, "雪", path="unicode.txt")) == [(37, 40), (40, 43)]
    crlf = run(files, index, "TOKEN(", path="crlf.txt", context=1)
    assert crlf[0]["line_text"] == "TOKEN(one TOKEN(two" and crlf[0]["before"] == ["before"] and crlf[0]["after"] == ["after"]
    assert ranges(crlf) == [(8, 14), (18, 24)]
    assert ranges(run(files, index, "TOKEN(boundary")) == [(65535, 65549)]
    assert ranges(run(files, index, "bare-cr-hit")) == [(5, 16)]


def test_regexes(files, index):
    assert ranges(run(files, index, r"TOKEN\(\w+", literal=False, path="crlf.txt")) == [(8, 17), (18, 27)]
    assert spots(run(files, index, r"\p{Greek}+", literal=False)) == [("src/main.ts", 5)]
    assert spots(run(files, index, r"(?x) RARE  _TOKEN # note", literal=False)) == [("src/main.ts", 1)]
    assert spots(run(files, index, r"^GLOB_T$", literal=False)) == [("src/helper.go", 3), ("src/main.ts", 4)]
    assert spots(run(files, index, r"caf\w\b", literal=False)) == [("unicode.txt", 1)]
    assert spots(run(files, index, r"l[5-8&&[^67]]", literal=False)) == [("context.txt", 5), ("context.txt", 8)]
    for bad in (r"(?<=a)b", r"(a)\1", r"(?=a)", "(", "[z-a]"):
        with pytest.raises(InvalidRegex):
            search.search(request(bad, literal=False), files=files)


def test_multiline_and_context(files, index):
    rows = run(files, index, "BEGIN\nline alpha\nline beta\nEND", multiline=True)
    assert spots(rows) == [("multiline.txt", 1)] and rows[0]["line_text"] == "BEGIN\nline alpha\nline beta\nEND" and ranges(rows) == [(0, 30)]
    found = search.search(request("CTX", context=2), files=files).found
    shown = [(r.line_no, r.is_match, r.group_no) for r in present.context_groups(present.display_lines(found)).orderBy("line_no").collect()]
    assert [x[0] for x in shown] == [1, 2, 3, 4, 5, 6, 8, 9, 10] and [x[0] for x in shown if x[1]] == [1, 4, 10]
    assert [x[2] for x in shown] == [1] * 6 + [2] * 3
    rows = [r.row for r in present.rendered(found).orderBy("line_no").collect()]
    assert rows[0] == "context.txt:1: CTX" and rows[1] == "context.txt-2- l2" and rows[6] == "--\ncontext.txt-8- l8"


def test_limits_order_and_totals(files):
    result = search.search(request("MANY", limit=2), files=files)
    assert where(result) == [("src/helper.go", 2), ("src/main.ts", 2)]
    t = result.totals.first()
    assert (t.total_matches, t.total_occurrences, t.displayed, t.truncated) == (3, 4, 2, True)
    assert where(search.search(request("MANY", limit=0), files=files)) == []
    assert [r.path for r in search.search(request("ordering"), files=files).matches.collect()] == ["src/😀.txt", "src/\ue000.txt"]
    assert SearchRequest("x").line_limit == 100 and SearchRequest("x", limit=-1).line_limit == 0 and SearchRequest("x", limit=None).line_limit is None
    with pytest.raises(ValueError):
        SearchRequest("x", limit=float("inf")).line_limit  # noqa: B018


def test_binary_files_give_no_lines(files, index):
    assert run(files, index, "binary-hit") == []
    hits = search.binary_hits(files, request("binary-hit")).collect()
    assert [(r.path, r.before_nul) for r in hits] == [("binary.bin", True)]
    assert [r.before_nul for r in search.binary_hits(files, request("RARE_TOKEN")).collect()] == [False]


def test_case_folding_beyond_ascii(files, index):
    assert spots(run(files, index, "kelvin", ignore_case=True)) == [("kelvin.txt", 1)]
    assert spots(run(files, index, "miss", ignore_case=True)) == [("kelvin.txt", 2)]


def test_routes(files, index):
    route = lambda *a, **k: (planner.plan(request(*a, **k), index).route, planner.plan(request(*a, **k), index).reason)
    assert route("RARE_TOKEN") == ("index", None) and route("ABSENT_TOKEN") == ("empty", None)
    assert route("of") == ("scan", "literal_too_short") and route(":::") == ("scan", "no_indexed_gram") and route("a\nb") == ("scan", "literal_with_line_break")
    assert route("x.y", literal=False, multiline=True) == ("scan", "multiline") and route("xyz", no_ignore=True) == ("scan", "no_ignore")
    assert route("café", ignore_case=True) == ("scan", "non_ascii_case_fold") and route("a(?=b)", literal=False)[0] == "invalid"
    plan = planner.plan(request("RARE_TOKEN"), index)
    assert plan.df == 3 and plan.gram == "ARE"


def test_index_plan_reads_by_gram(spark, tmp_path, files):
    from sieveline.sources import index as I

    folder = f"file://{tmp_path}/index"
    own = I.write(files, folder, snapshot="s1")
    assert own.generation == 1 and I.open_index(spark, folder, check=True).generation == 1
    result = search.search(request("GLOB_T"), own)
    plan = result.found._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[[^\]]*(GreaterThanOrEqual|EqualTo)\(fil", plan)
    again = I.write(files.where("file_id > 0"), folder)
    assert again.generation == 2 and I.vacuum(spark, folder) == ["gen=1"]
    assert where(search.search(request("RARE_TOKEN"), I.open_index(spark, folder))) == []
    with pytest.raises(FileNotFoundError):
        I.open_index(spark, f"file://{tmp_path}/none")


def test_random_literals_against_a_plain_scan(spark):
    r = random.Random(0x12345678)
    rows = [(i, f"f{i:02}.txt", "".join(r.choice("abcdef\n") for _ in range(512))) for i in range(24)]
    files = spark.createDataFrame(rows, "file_id long, path string, text string").cache()
    own = Index.in_memory(files)
    for needle in ("abc", "aaaa", "rare-needle", "fedc", "not-present"):
        want = set()
        for _, path, text in rows:
            at = 0
            for line in text.split("\n"):
                want |= {(path, at + m.start(), at + m.end()) for m in re.finditer(needle, line)}
                at += len(line) + 1
        for result in (search.search(request(needle), own), search.search(request(needle), files=files)):
            assert {tuple(x) for x in search.occurrences(result.found).collect()} == want


def test_texts_for_people(files):
    result = search.search(request("MANY", limit=2, context=1), files=files)
    text = present.to_text(result)
    assert "src/helper.go:2: MANY" in text and "[Showing 2 of 3 matches (limit 2)." in text
    assert present.to_text(search.search(request("ABSENT_TOKEN"), files=files)).startswith("No matches found")
    assert present.to_grouped_text(search.search(request("MANY"), files=files)).startswith("Found 3 matches:\n\nsrc/helper.go\nLine 2: MANY\n\nsrc/main.ts\nLine 2:")
    long = present.rendered(search.search(request("TOKEN(boundary"), files=files).found).first().row
    assert long.endswith("... [truncated]") and len(long) == len("long.txt:1: ") + 500 + len("... [truncated]")
    rows = present.rendered(search.search(request("MANY"), files=files).found)
    assert [r.line_no for r in present.within_budget(rows, 22).collect()] == [2]


def test_lines_and_flags(spark, files):
    lines = {(r.path, r.line_no): (r.line_start, r.line) for r in corpus.lines(files).collect()}
    assert lines["crlf.txt", 3] == (29, "after\r") and ("empty.txt", 1) not in lines and lines["unicode.txt", 2] == (18, "alpha ::: :::")
    flags = {r.path: r for r in corpus.with_flags(files).collect()}
    assert flags["binary.bin"].first_nul == 10 and flags["bare-cr.txt"].has_bare_cr and not flags["crlf.txt"].has_bare_cr
    assert flags["kelvin.txt"].has_kelvin and flags["kelvin.txt"].has_long_s and flags[".hidden/hidden.ts"].hidden
    rows = [(1, b"\xef\xbb\xbfTOKEN"), (2, "héllo".encode("utf-16")), (3, b"\xfe\xff" + "x".encode("utf-16-be")), (4, b"ok\xff!"), (5, b"")]
    out = spark.createDataFrame(rows, "i int, b binary").select("i", corpus.decoded(F.col("b")).alias("t")).orderBy("i").collect()
    assert [r.t for r in out] == ["TOKEN", "héllo", "x", "ok\ufffd!", ""]


def test_folders(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/b/x.txt").write_text("needle\n")
    (tmp_path / "y.md").write_text("needle\n")
    found = corpus.folder_files(spark, str(tmp_path))
    assert sorted(r.path for r in found.collect()) == ["a/b/x.txt", "y.md"]
    assert [r.path for r in search.search(request("needle"), files=corpus.folder_files(spark, str(tmp_path), "*.txt")).matches.collect()] == ["a/b/x.txt"]
    before = spark.createDataFrame(found.select("path", "modified", "length").collect())
    (tmp_path / "y.md").write_text("changed a lot\n")
    assert [r.path for r in corpus.stable(before, corpus.folder_files(spark, str(tmp_path))).collect()] == ["y.md"]


def test_comparisons(spark):
    a = spark.createDataFrame([("p", 1, 2), ("p", 3, 4), ("p", 3, 4)], "path string, abs_start long, abs_end long")
    b = spark.createDataFrame([("p", 3, 4), ("q", 1, 2)], "path string, abs_start long, abs_end long")
    assert sorted((r.path, r.abs_start, r.side, r.times) for r in compare.differences(a, b).collect()) == [("p", 1, "missing", 1), ("p", 3, "missing", 1), ("q", 1, "extra", 1)]
    assert compare.joined(a.distinct(), b).where("in_expected AND in_got").count() == 1
    assert compare.is_set(a).first() == (3, 2, False) and compare.is_set(a.limit(0)).first() == (0, 0, True)
    assert compare.union_once(a, b, key=("path", "abs_start")).count() == 3
    out = spark.createDataFrame([("passed", 0, 0), ("failed", 2, 1)], "status string, missing long, extra long")
    assert compare.rollup(out).first() == (2, 1, 0, 2, 1, False) and compare.rollup(out.limit(1)).first().passed
    d = lambda rows: compare.digest_of(spark.createDataFrame(rows, "g int, v string"), ["g"], "v").first().digest
    assert d([(1, "ab"), (1, "c")]) == d([(1, "c"), (1, "ab")]) != d([(1, "a"), (1, "bc")])


def test_long_files_and_lines(spark):
    from sieveline.functions.arrays import running_starts

    sizes = [[], [3], list(range(127)), list(range(128)), list(range(129)), list(range(1000))]
    got = spark.createDataFrame([(x,) for x in sizes], "n array<bigint>").select("n", running_starts(F.col("n")).alias("s")).collect()
    assert all(r.s == [sum(r.n[:i]) for i in range(len(r.n))] for r in got)
    text = "é needle " * 700 + "\n" + "".join(f"line {i} needle\n" for i in range(3000))
    files = spark.createDataFrame([(1, "a", text)], "file_id long, path string, text string")
    found = search.occurrences(search.search(request("needle"), files=files).found).collect()
    data = text.encode()
    assert sorted((r.abs_start, r.abs_end) for r in found) == [(m.start(), m.end()) for m in re.finditer(b"needle", data)]
    found = search.search(request("needle\nline [0-9]+", literal=False, multiline=True, context=1), files=files).found.collect()
    want = [(m.start(), m.end()) for m in re.finditer(rb"needle\nline [0-9]+", data)]
    assert sorted((r.ranges[0].abs_start, r.ranges[0].abs_end) for r in found) == want and len(want) > 1000
    assert all(r.line_no == data[: r.ranges[0].abs_start].count(b"\n") + 1 and len(r.before) <= 1 for r in found)


def test_a_search_reads_little_else_than_its_candidates(spark, tmp_path):
    """Parts by their folders, pages by their ids: rows read follow the candidates, by grams,
    paths and both; lists too long to be held are joined."""
    import numpy as np

    from sieveline.sources import index as I

    rows = [(i, f"d{i % 50}/f{i}.txt", "common words " * 20 + (f"needle_{i}_z" if i % 500 == 7 else "")) for i in range(4000)]
    files = spark.createDataFrame(rows, "file_id long, path string, text string")
    own = I.write(files, f"file://{tmp_path}/index", part_bytes=100_000)
    assert len(own.parts) > 5 and sum(1 for _ in os.scandir(f"{tmp_path}/index/gen=1/files") if _.name.startswith("part=")) == len(own.parts)

    def read(found):
        got = found.collect()
        plan = found._jdf.queryExecution().executedPlan()
        if "Adaptive" in plan.getClass().getName():
            plan = plan.executedPlan()
        leaves = plan.collectLeaves().iterator()
        n = 0
        while leaves.hasNext():
            leaf = leaves.next()
            if leaf.getClass().getSimpleName() == "FileSourceScanExec":
                n += leaf.metrics().apply("numOutputRows").value()
        return len(got), n

    one = read(search.search(request("needle_507_z", literal=True), own).found)
    assert one[0] == 1 and one[1] <= 2 * I.PAGE_ROWS
    some = read(search.search(request("needle_", literal=True), own).found)
    assert some[0] == 8 and some[1] <= 10 * I.PAGE_ROWS
    assert read(search.search(request("common", literal=True, limit=None), own).found) == (4000, 4000), "not worth it"
    scoped = read(search.search(request("common", literal=True, path="d3", limit=None), own).found)
    assert scoped[0] == 80 and scoped[1] < 4000
    assert read(search.search(request("common", literal=True, glob="f507.txt"), own).found)[1] <= 2 * I.PAGE_ROWS
    few = planner.plan(request("needle_", literal=True), own)
    assert planner.named(few, request("needle_", literal=True), own).tolist() == [i for i, *_ in rows if i % 500 == 7]
    assert planner.ranges(np.array([1, 2, 3, 9, 10, 40]), 3) == [(1, 3), (9, 10), (40, 40)] and planner.ranges(np.array([5]), 3) == [(5, 5)]
    assert planner.ranges(np.array([-(2**63), 2**63 - 1]), 1) == [(-(2**63), 2**63 - 1)]
    held, planner.HELD_IDS = planner.HELD_IDS, 3
    try:
        assert read(search.search(request("needle_", literal=True), own).found)[0] == 8
    finally:
        planner.HELD_IDS = held


def test_writers_cannot_meet_and_readers_find_a_whole_index(spark, tmp_path, files):
    from sieveline.sources import index as I

    folder = f"file://{tmp_path}/index"
    assert I._claimed(spark, folder) == 1 and I._claimed(spark, folder) == 2, "two writers at once"
    with pytest.raises(FileNotFoundError):
        I.open_index(spark, folder)
    assert I.write(files, folder, snapshot="a").generation == 3
    assert I._claimed(spark, folder) == 4
    assert I.open_index(spark, folder).generation == 3 and I.manifest(spark, folder)["snapshot"] == "a", "4 is at work"
    assert I.write(files, folder).generation == 5 and I.vacuum(spark, folder) == ["gen=3"]
    assert I.open_index(spark, folder, check=True).generation == 5
