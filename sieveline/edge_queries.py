"""Registered queries beside line search: encodings, binary files, ignore rules, globs, routes,
serving, change feeds and traces, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import globs
from .operators import compare, freshness, present, search, serving, trace
from .plans import planner
from .queries import _FILES, _GRAMS, _SHOWN, LIMIT, LITERAL, RARE, REQUESTS, _lines, _literal_hits, _literal_lines, _literal_spans, _regex_hits, built, feed, files, lines_of, literal, regex, scanned, scratch, spans_of
from .sources import corpus, index
from .streaming import changes

ACCENTED, WORDS = "É", "und"
TASKS_A_PART = 4
BRACES, NESTED_BRACES = "{en/src1*,de}/**/*.txt", "doc-00{0,{1,2}0}*{3,{5,7}}.txt"
GLOBS = ("*.ts", "src/**/*.spec.js", "!x*", "a*", "**/lib/*/index?.ts", "[ab]c")
#: (folder, rule): outer rules first, as ignore files on the way down would give them.
RULES = (("", "doc-*1.txt"), ("", "src2/"), ("en", "/src1?"), ("en", "!doc-*1.txt"), ("de/src3", "*7.txt"))


def decoded_text(spark, sf_dir):
    """Documents as bytes in UTF-8 with and without a mark, and in UTF-16 of both orders."""
    text, i = F.coalesce("text", F.lit("")), F.col("doc_id") % 4
    content = F.when(i == 0, F.encode(text, "UTF-8")).when(i == 1, F.concat(F.lit(b"\xef\xbb\xbf"), F.encode(text, "UTF-8"))).when(i == 2, F.concat(F.lit(b"\xff\xfe"), F.encode(text, "UTF-16LE"))).otherwise(F.encode(text, "UTF-16"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", corpus.decoded(content).alias("t")).select("doc_id", F.length("t").cast("long").alias("n"), F.sha2(F.encode("t", "UTF-8"), 256).alias("sha256"))


def with_nul(spark, sf_dir) -> DataFrame:
    """Every fifth file has a NUL in its middle, every tenth one at its start as well."""
    t, i = F.col("text"), F.col("file_id")
    half = F.floor(F.length(t) / 2).cast("int")
    middle = F.concat(t.substr(F.lit(1), half), F.lit("\0"), t.substr(half + 1, F.length(t)))
    return files(spark, sf_dir).withColumn("text", F.when(i % 10 == 0, F.concat(F.lit("\0"), middle)).when(i % 5 == 0, middle).otherwise(t))


def binary_flags(spark, sf_dir):
    return corpus.with_flags(with_nul(spark, sf_dir)).groupBy("is_binary", "is_early_binary").agg(F.count("*").alias("n"), F.sum("first_nul").alias("first_nul"))


def binary_hits(spark, sf_dir):
    return search.binary_hits(with_nul(spark, sf_dir), literal()).select("path", "before_nul", "reason")


def binary_lines(spark, sf_dir):
    """Files with a NUL give no lines."""
    return lines_of(search.search(literal(RARE), files=with_nul(spark, sf_dir)).found)


def before_nul(spark, sf_dir):
    """Occurrences in the whole texts that begin before their file's NUL."""
    found = search.occurrences(search.search(literal(RARE), files=files(spark, sf_dir)).found)
    return serving.before_nul(found, corpus.with_flags(with_nul(spark, sf_dir)))


def ignored_files(spark, sf_dir):
    return corpus.mark_ignored(files(spark, sf_dir), list(RULES)).select("path", "ignored")


def ignore_files_read(spark, sf_dir):
    """The same by rules that lie in the tree as ignore files."""
    rules = spark.createDataFrame([("/".join(x for x in (folder, ".gitignore") if x), "# rules\n\n" + "".join(r + "\n" for f, r in RULES if f == folder)) for folder in dict(RULES)], "path string, text string")
    marked = corpus.mark_ignored(files(spark, sf_dir), corpus.ignore_rules(rules))
    return lines_of(search.search(literal(RARE), files=marked).found)


def no_ignore(spark, sf_dir):
    """The same files with ignore rules set aside."""
    return lines_of(search.search(literal(RARE, no_ignore=True), files=corpus.mark_ignored(files(spark, sf_dir), list(RULES))).found)


def left_out_paths(spark, sf_dir):
    names = F.array(*map(F.lit, (".git/", ".sieveline/", "x/.git/", "", ".github/")))
    paths = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.get(names, (F.col("event_id") % 5).cast("int")), "event_type").alias("path"))
    return paths.groupBy("path").agg(F.count("*").alias("n")).withColumn("left_out", globs.left_out(F.col("path"))).withColumn("hidden", globs.is_hidden(F.col("path")))


def escaping_paths(spark, sf_dir):
    """Paths that lead out of their root are no files."""
    names = F.array(*map(F.lit, ("../", "a/../", "/", "", "a..b/")))
    paths = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.get(names, (F.col("event_id") % 5).cast("int")), "event_type").alias("path"))
    return paths.groupBy("path").agg(F.count("*").alias("n")).withColumn("escapes", corpus.escapes(F.col("path")))


def glob_literals(spark, sf_dir):
    return spark.createDataFrame([(g, "|".join(globs.mandatory_literals(g)), globs.simple(g)) for g in GLOBS], "glob string, literals string, simple boolean")


def unstable_files(spark, sf_dir):
    """Files whose length or time differs between two listings: every seventh has changed, every
    eleventh is gone."""
    listed = files(spark, sf_dir).select("file_id", "path", F.lit(0).alias("modified"), F.octet_length("text").alias("length"))
    after = listed.where("file_id % 11 <> 0").withColumn("length", F.col("length") + (F.col("file_id") % 7 == 0).cast("int"))
    return corpus.stable(listed, after)


def plans_of_requests(spark, sf_dir):
    """Route, reason and required grams of each kind of request."""
    rows = [(n, p.route, p.reason, ",".join(p.required), p.blockers) for n, p in ((n, planner.plan(r, built(spark, sf_dir))) for n, r in REQUESTS.items())]
    return spark.createDataFrame(rows, "request string, route string, reason string, required string, blockers boolean")


def fallback_reasons(spark, sf_dir):
    plans = {name: planner.plan(r, built(spark, sf_dir)) for name, r in REQUESTS.items()}
    return spark.createDataFrame([(n, p.route, p.reason, p.gram, p.df) for n, p in plans.items()], "request string, route string, reason string, gram string, df long")


def index_codec(spark, sf_dir):
    """Postings of an index written in another codec."""
    own = index.write(files(spark, sf_dir), scratch(spark, "index"), codec="gzip")
    return letters(own)


def letters(own: index.Index):
    """Of each first letter of a gram, its postings and files. A file lies in one part, so files are
    told apart within parts, of which a task has few however large the index is: lists are dealt out
    whole, and only then opened."""
    lists = own.lists.where(F.col("gram") != index.FOLDED_LETTERS).select(F.substring("gram", 1, 1).alias("letter"), "part", "ids")
    dealt = lists.repartition(TASKS_A_PART * len(own.parts), "letter", "part").select("letter", "part", F.explode("ids").alias("file_id"))
    each = dealt.groupBy("letter", "part", "file_id").agg(F.count("*").alias("n"))
    return each.groupBy("letter").agg(F.sum("n").alias("n"), F.count("file_id").alias("n_files"))


def index_generations(spark, sf_dir):
    """Two generations, of which the first is vacuumed, and one that is latched as invalid."""
    at, own = scratch(spark, "index"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("file_id"), F.concat(F.lit("item/"), F.col("item_id").cast("string")).alias("path"), "text")
    index.write(own, at, snapshot="s1")
    second = index.write(own.where("file_id % 2 = 0"), at, snapshot="s2")
    gone = index.vacuum(spark, at)
    first, again = index.invalidate(spark, at, "changed"), index.invalidate(spark, at, "changed again")
    now = index.open_index(spark, at, check=True)
    plan = search.search(literal(), now, own).plan
    row = (second.generation, now.n_files, index.manifest(spark, at)["snapshot"], ",".join(gone), first, again, plan.route, plan.reason)
    return spark.createDataFrame([row], "generation long, n_files long, snapshot string, removed string, latched boolean, again boolean, route string, reason string")


def matches_json(spark, sf_dir):
    return present.as_json(search.search(literal(RARE), files=files(spark, sf_dir)).found)


def text_output(spark, sf_dir):
    result = search.search(literal(RARE, limit=LIMIT), files=files(spark, sf_dir))
    return spark.createDataFrame([(present.to_text(result),)], "text string")


def grouped_output(spark, sf_dir):
    return spark.createDataFrame([(present.to_grouped_text(search.search(literal(RARE), files=files(spark, sf_dir)), LIMIT),)], "text string")


def full_outer_identity(spark, sf_dir):
    """Two searches' occurrences side by side."""
    a, b = (spans_of(literal(LITERAL, **more))(spark, sf_dir) for more in ({"path": "en"}, {"glob": "*5.txt"}))
    return compare.joined(a, b).groupBy("in_expected", "in_got").agg(F.count("*").alias("n"))


def differences(spark, sf_dir):
    a, b = (spans_of(literal(LITERAL, path=p))(spark, sf_dir) for p in ("en", "en/src1"))
    return compare.differences(a, b).groupBy("side").agg(F.count("*").alias("n"), F.sum("times").alias("times"))


def stage_spent(spark, sf_dir):
    """Events as attempts: milliseconds of each type by user."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return serving.spent(e.select("user_id", F.col("event_type").alias("stage"), F.round(F.col("value") * 100).cast("long").alias("ms")), "user_id")


def recovered_search(spark, sf_dir):
    """A search by an index made, unwritten, of the files as they are now."""
    base = files(spark, sf_dir)
    dirty = base.where("file_id % 10 = 0").select("path", F.lit(1).cast("long").alias("generation"), (F.col("file_id") % 20 == 0).alias("tombstone"))
    changed = base.where("file_id % 10 = 0").withColumn("text", F.concat(F.lit(RARE + " new\n"), "text"))
    return search.search(literal(RARE), serving.recovered(base, dirty, changed)).found.select("path", "line_no", "line_text")


def distrusted_search(spark, sf_dir):
    """A change feed with an unnamed path: the search scans and says why; a listing restores
    trust, and the index serves again."""
    table = changes.DirtyTable(spark, f"{scratch(spark, 'changes')}/table")
    own, now = built(spark, sf_dir), files(spark, sf_dir)
    out = []
    for name, events in (("known", [("a", 1, False)]), ("unknown", [(None, 2, False)]), ("trusted", None), ("head", [(".git/HEAD", 3, False)]), ("ref", [(".git/refs/heads/x", 4, False)]), ("listed", None)):
        table.trust() if events is None else table.mark(spark.createDataFrame(events, changes.EVENT))
        plan = search.search(literal(RARE), own, now, distrust=table.distrust()).plan
        state = table.state()
        out.append((name, plan.route, plan.reason, state["generation"], state["trusted"]))
    return spark.createDataFrame(out, "step string, route string, reason string, generation long, trusted boolean")


def overlay_generations(spark, sf_dir):
    """The overlay of changed files that follows the change feed, and its generation."""
    table = changes.DirtyTable(spark, f"{scratch(spark, 'changes')}/table")
    base = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("file_id"), base_path().alias("path"), "text")
    events = feed(spark, sf_dir)
    table.mark(events.where("generation < 5000"))
    table.build_overlay(base)
    table.mark(events.where("generation >= 5000"))
    table.build_overlay(base)
    now, generation = table.overlay()
    return now.select("path", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(generation).cast("long").alias("generation"))


def base_path():
    return F.concat(F.lit("src/doc-"), F.lpad(F.pmod("doc_id", F.lit(1_000_000)).cast("string"), 6, "0"), F.lit(".txt"))


def compacted_changes(spark, sf_dir):
    """The dirty set after more batches than are kept apart."""
    table = changes.DirtyTable(spark, f"{scratch(spark, 'changes')}/table")
    events = feed(spark, sf_dir)
    for k in range(changes.COMPACT + 3):
        table.mark(events.where(F.pmod("generation", F.lit(changes.COMPACT + 3)) == k), batch=k)
    return table.read().select("path", "generation", "tombstone")


def fence_outcomes(spark, sf_dir):
    """What a change while a query runs does to its result."""
    before = freshness.Fence(1, 1, "s")
    cases = {"none": before, "files": freshness.Fence(2, 1, "s"), "index": freshness.Fence(1, 2, "s"), "snapshot": freshness.Fence(1, 1, "t"), "trust": freshness.Fence(1, 1, "s", False), "files and index": freshness.Fence(2, 2, "s")}
    rows = []
    for name, after in cases.items():
        seen = iter([before, after])
        rows.append((name, *freshness.guarded(lambda: "rows", lambda: next(seen), lambda why: "scan")))  # noqa: B023
    return spark.createDataFrame(rows, "change string, answer string, reason string")


def gated_searches(spark, sf_dir):
    """Searches and a rebuild through one gate: how many searches ran at once, and whether any
    ran during the rebuild."""
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier, Event

    gate, both, rebuilding = serving.Gate(), Barrier(2, timeout=60), Event()
    own = files(spark, sf_dir)

    def reader():
        with gate.reading():
            both.wait()
            return search.matches(own, literal(RARE)).count(), rebuilding.is_set()

    def writer():
        with gate.writing():
            rebuilding.set()
            n = own.count()
            rebuilding.clear()
            return n

    with ThreadPoolExecutor(3) as pool:
        readers = [pool.submit(reader) for _ in range(2)]
        counts = [r.result() for r in readers]
        n_files = pool.submit(writer).result()
    return spark.createDataFrame([(counts[0][0], counts[1][0], n_files, any(during for _, during in counts))], "first long, second long, n_files long, met boolean")


def repository_paths(spark, sf_dir):
    roots = F.array(*map(F.lit, ("/repo", "/repo/", "/other/", "", "/repository/")))
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    path = F.concat(F.get(roots, (F.col("event_id") % 5).cast("int")), F.when(F.col("event_id") % 5 == 0, F.lit("")).otherwise(F.col("event_type")))
    return e.select(path.alias("path")).groupBy("path").agg(F.count("*").alias("n")).select(trace.repository_path(F.col("path"), "/repo").alias("shown"), "n")


def _runs(spark, sf_dir) -> DataFrame:
    """A run for each of the first events of a user; some are invalid."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id % 100 < 7")
    k = F.col("event_id") % 100
    null = lambda kind: F.lit(None).cast(kind)
    event = F.struct(
        F.col("event_type").alias("op"), F.lit("t").alias("tool"), F.lit("c").alias("tool_call_id"), F.lit(5.0).alias("start_ms"), F.when(k == 4, 1.0).otherwise(9.0).alias("end_ms"), F.lit(4.0).alias("duration_ms"),
        F.lit("ok").alias("status"), null("string").alias("actual_backend"), null("string").alias("fallback_reason"), null("bigint").alias("result_count"), null("boolean").alias("truncated"),
    )
    return e.select(
        F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("run_id"), F.lit("w").alias("workflow_id"), F.lit("c").alias("comparison_id"), F.when(k == 1, 0).otherwise(1).alias("attempt"), F.lit("<repo>").alias("repo"),
        null("string").alias("repo_sha"), F.lit("index").alias("backend_requested"), null("string").alias("model"), null("string").alias("thinking"), F.when(k == 2, "no hash").otherwise(F.sha2(F.encode(F.lit("x"), "UTF-8"), 256)).alias("prompt_hash"),
        F.when(k == 5, "yesterday").otherwise("2024-01-01T00:00:00Z").alias("started_at"), F.when(k == 3, -1.0).otherwise(10.0).alias("total_ms"), F.lit("ok").alias("status"),
        null("struct<input:double,output:double,cache_read:double,cache_write:double,reasoning:double,total_tokens:double,cost_total:double>").alias("token_usage"), F.array(event).alias("events"),
    )


def runs_read(spark, sf_dir):
    """Runs as JSON read back, and what is wrong with some."""
    at = f"{scratch(spark, 'runs')}/json"
    _runs(spark, sf_dir).write.json(at)
    return trace.read_runs(spark, at).select("run_id", "attempt", "invalid", F.size("events").alias("n_events"))


def runs_written(spark, sf_dir):
    """Valid runs are written and read back; a set with an invalid one is refused whole."""
    at = scratch(spark, "runs")
    own = _runs(spark, sf_dir)
    trace.write_runs(own.where("total_ms > 0 AND attempt = 1 AND length(prompt_hash) = 64 AND started_at LIKE '2%' AND events[0].end_ms > 5"), f"{at}/good")
    try:
        trace.write_runs(own, f"{at}/bad")
        refused = False
    except ValueError:
        refused = True
    return trace.trace_events(trace.read_runs(spark, f"{at}/good")).groupBy("op").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("ms")).withColumn("refused", F.lit(refused))


QUERIES = {f.__name__: f for f in (
    decoded_text, binary_flags, binary_hits, binary_lines, before_nul, ignored_files, ignore_files_read, no_ignore, left_out_paths, escaping_paths, glob_literals, unstable_files, plans_of_requests, fallback_reasons, index_codec,
    index_generations, matches_json, text_output, grouped_output, full_outer_identity, differences, stage_spent, recovered_search, distrusted_search, overlay_generations, compacted_changes, fence_outcomes, gated_searches,
    repository_paths, runs_read, runs_written,
)} | {
    "glob_braces": scanned(literal(RARE, glob=BRACES)), "glob_nested_braces": scanned(literal(RARE, glob=NESTED_BRACES)), "regex_plain": scanned(regex(LITERAL)),
    "literal_ci_non_ascii": scanned(literal(ACCENTED, ignore_case=True)), "regex_bounded": scanned(regex("[a-z]{2,4}tionsh?[ .]")),
}

_NUL = f"""{_FILES.replace("files AS", "base AS", 1)},
files AS (
  SELECT file_id, path, CASE WHEN file_id % 10 = 0 THEN chr(0) || m WHEN file_id % 5 = 0 THEN m ELSE text END AS text
  FROM (SELECT *, left(text, length(text) // 2) || chr(0) || substr(text, length(text) // 2 + 1) AS m FROM base)),
flags AS (SELECT *, contains(text, chr(0)) AS b, CASE WHEN contains(text, chr(0)) THEN strlen(split_part(text, chr(0), 1))::BIGINT END AS nul FROM files)"""
_IGNORED = """CASE WHEN regexp_matches(path, '^de/src3/(?:.*/)?[^/]*7\\.txt$') THEN true WHEN regexp_matches(path, '^en/(?:.*/)?doc-[^/]*1\\.txt$') THEN false
  WHEN regexp_matches(path, '^en/src1[^/](?:/|$)') THEN true WHEN regexp_matches(path, '^(?:.*/)?src2/') THEN true ELSE regexp_matches(path, '^(?:.*/)?doc-[^/]*1\\.txt$') END"""
_LISTED = "SELECT ({names})[(event_id % 5)::INTEGER + 1] || event_type AS path, count(*) AS n FROM events GROUP BY 1"
_LINES = {"literal": LITERAL, "rare": RARE, "absent": REQUESTS["absent"].pattern, "scoped": LITERAL}
#: Route, reason and required grams that a regular expression's request has, as text.
_OTHERS = [
    ("no_gram", "scan", "literal_too_short", ""), ("short", "scan", "literal_too_short", ""), ("regex", "index", None, "ion,tio"), ("regex_no_gram", "scan", "no_indexed_gram", ""), ("multiline", "scan", "multiline", ""),
    ("no_ignore", "scan", "no_ignore", ""), ("folded", "index", None, "ato,hat,tha,ton"),
]
_INVALID = planner.plan(REQUESTS["look_ahead"], None).reason.replace("'", "''")


def _text(x) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x).lower()


def _plans() -> str:
    literals = " UNION ALL ".join(f"SELECT '{n}' AS request, '{'empty' if n == 'absent' else 'index'}' AS route, NULL AS reason, '{p}' AS p" for n, p in _LINES.items())
    rest = ", ".join(f"({', '.join(map(_text, row))})" for row in [*_OTHERS, ("look_ahead", "invalid", _INVALID, "")])
    return f"""plans AS (
  SELECT request, route, reason, array_to_string(list_sort(list_distinct(list_transform(range(1, length(p) - 1), lambda i: substr(p, i, 3)))), ',') AS required FROM ({literals})
  UNION ALL SELECT * FROM (VALUES {rest}) AS t(request, route, reason, required))"""


def _grouped(found: str) -> str:
    return f"SELECT path, path || chr(10) || string_agg('Line ' || line_no::VARCHAR || ': ' || line, chr(10) ORDER BY line_no) AS block, count(*) AS n FROM {found} GROUP BY path"


_RECOVERED = _FILES.replace("text", f"CASE WHEN doc_id % 10 = 0 THEN '{RARE} new' || chr(10) || text ELSE text END AS text", 1)
_CHANGED = """dirty AS (
  SELECT path, max(generation) AS generation, arg_max(tombstone, generation) AS tombstone
  FROM (SELECT 'src/doc-' || lpad(((user_id * 7) % 1000000)::VARCHAR, 6, '0') || '.txt' AS path, event_id::BIGINT AS generation, event_type = 'error' AS tombstone FROM events) GROUP BY path),
base AS (SELECT 'src/doc-' || lpad((doc_id % 1000000)::VARCHAR, 6, '0') || '.txt' AS path, strlen(text)::BIGINT AS n_bytes FROM documents)"""

ORACLE = {
    "decoded_text": "SELECT doc_id, length(coalesce(text, '')) AS n, sha256(coalesce(text, '')) AS sha256 FROM documents",
    "binary_flags": f"WITH {_NUL} SELECT b AS is_binary, coalesce(nul < 65536, false) AS is_early_binary, count(*) AS n, sum(nul)::BIGINT AS first_nul FROM flags GROUP BY 1, 2",
    "binary_hits": f"""WITH {_NUL} SELECT path, contains(split_part(text, chr(0), 1), '{LITERAL}') AS before_nul,
  CASE WHEN nul < 65536 THEN 'early_binary' WHEN contains(split_part(text, chr(0), 1), '{LITERAL}') THEN 'late_binary' END AS reason FROM flags WHERE b AND contains(text, '{LITERAL}')""",
    "binary_lines": _literal_lines(RARE, where="file_id % 5 <> 0"),
    "before_nul": f"""SELECT s.path, abs_start, abs_end FROM ({_literal_spans(RARE)}) s JOIN (WITH {_FILES} SELECT path, file_id, strlen(left(text, length(text) // 2)) AS half FROM files) f USING (path)
WHERE file_id % 5 <> 0 OR (file_id % 10 <> 0 AND abs_start < half)""",
    "ignored_files": f"WITH {_FILES} SELECT path, {_IGNORED} AS ignored FROM files",
    "ignore_files_read": _literal_lines(RARE, where=f"NOT ({_IGNORED})"),
    "no_ignore": _literal_lines(RARE),
    "left_out_paths": f"""WITH p AS ({_LISTED.format(names="['.git/', '.sieveline/', 'x/.git/', '', '.github/']")})
SELECT path, n, starts_with(path, '.git/') OR starts_with(path, '.sieveline/') AS left_out, starts_with(path, '.') OR contains(path, '/.') AS hidden FROM p""",
    "escaping_paths": f"""WITH p AS ({_LISTED.format(names="['../', 'a/../', '/', '', 'a..b/']")})
SELECT path, n, starts_with(path, '/') OR starts_with(path, '../') OR contains(path, '/../') AS escapes FROM p""",
    "glob_literals": "SELECT * FROM (VALUES ('*.ts', '.ts', true), ('src/**/*.spec.js', 'src|.spec.js', true), ('!x*', '', false), ('a*', '', true), ('**/lib/*/index?.ts', 'lib|index|.ts', false), ('[ab]c', '', false)) AS t(\"glob\", literals, simple)",
    "unstable_files": f"WITH {_FILES} SELECT path FROM files WHERE file_id % 11 = 0 OR file_id % 7 = 0",
    "plans_of_requests": f"WITH {_plans()} SELECT request, route, reason, required, false AS blockers FROM plans",
    "fallback_reasons": f"""WITH {_FILES}, {_GRAMS}, {_plans()}, df AS (SELECT gram, count(*) AS df FROM postings GROUP BY gram), folded AS (SELECT lower(gram) AS gram, sum(df)::BIGINT AS df FROM df GROUP BY 1),
need AS (SELECT request, unnest(string_split(required, ',')) AS gram FROM plans WHERE route = 'index'),
met AS (SELECT request, gram, CASE WHEN request = 'folded' THEN (SELECT df FROM folded f WHERE f.gram = need.gram) ELSE (SELECT df FROM df d WHERE d.gram = need.gram) END AS df FROM need),
one AS (SELECT request, arg_min(gram, (df, gram)) AS gram, min(df) AS df FROM met GROUP BY request)
SELECT request, route, reason, one.gram, CASE WHEN route = 'empty' THEN 0 ELSE one.df END AS df FROM plans LEFT JOIN one USING (request)""",
    "index_codec": f"WITH {_FILES}, {_GRAMS} SELECT substr(gram, 1, 1) AS letter, count(*) AS n, count(DISTINCT file_id) AS n_files FROM postings GROUP BY 1",
    "index_generations": "SELECT 2::BIGINT AS generation, count(*) AS n_files, 's2' AS snapshot, 'gen=1' AS removed, true AS latched, false AS again, 'scan' AS route, 'changed' AS reason FROM benchmark WHERE item_id % 2 = 0",
    "matches_json": f"""WITH {_literal_hits(RARE)}, placed AS (
  SELECT path, line_no, line, line_at, list_transform(range(1, len(p)), lambda k: strlen(array_to_string(p[1:k], '{RARE}'))::BIGINT) AS s FROM hits)
SELECT path, line_no, to_json({{'path': path, 'line_no': line_no, 'line_text': line, 'ranges': list_transform(s, lambda x: {{'abs_start': line_at + x, 'abs_end': line_at + x + {len(RARE)}, 'line_start': x, 'line_end': x + {len(RARE)}}}),
  'before': []::VARCHAR[], 'after': []::VARCHAR[]}})::VARCHAR AS json FROM placed""",
    "text_output": f"""WITH {_literal_hits(RARE)}, first AS (SELECT path, line_no, line FROM hits ORDER BY path, line_no LIMIT {LIMIT}),
rows AS (SELECT path, line_no, CASE WHEN line_no > lag(line_no) OVER (PARTITION BY path ORDER BY line_no) + 1 THEN '--' || chr(10) ELSE '' END || path || ':' || line_no::VARCHAR || ': ' ||
  CASE WHEN length(line) > 500 THEN left(line, 500) || '... [truncated]' ELSE line END AS row FROM first),
n AS (SELECT count(*) AS n, least(count(*), {LIMIT}) AS shown FROM hits)
SELECT (SELECT coalesce(string_agg(row, chr(10) ORDER BY path, line_no), 'No matches found') FROM rows) ||
  CASE WHEN shown < n THEN chr(10) || chr(10) || '[Showing ' || shown || ' of ' || n || ' matches (limit {LIMIT}). Increase limit or narrow path/glob]' ELSE '' END ||
  chr(10) || chr(10) || '[search: route=scan, matches=' || shown || '/' || n || ', fallback=no_index]' AS text FROM n""",
    "grouped_output": f"""WITH {_literal_hits(RARE)}, first AS (SELECT path, line_no, line FROM hits ORDER BY path, line_no LIMIT {LIMIT}), blocks AS ({_grouped("first")})
SELECT CASE WHEN count(*) = 0 THEN 'No matches found.' ELSE 'Found ' || sum(n) || ' match' || CASE WHEN sum(n) = 1 THEN '' ELSE 'es' END || ':' || chr(10) || chr(10) || string_agg(block, chr(10) || chr(10) ORDER BY path) END AS text FROM blocks""",
    "full_outer_identity": f"""WITH s AS (SELECT starts_with(path, 'en/') AS in_expected, regexp_matches(path, '(^|/)[^/]*5\\.txt$') AS in_got FROM ({_literal_spans(LITERAL)}))
SELECT in_expected, in_got, count(*) AS n FROM s WHERE in_expected OR in_got GROUP BY 1, 2""",
    "differences": f"SELECT 'missing' AS side, count(*) AS n, count(*) AS times FROM ({_literal_spans(LITERAL)}) WHERE starts_with(path, 'en/') AND NOT starts_with(path, 'en/src1/') HAVING count(*) > 0",
    "stage_spent": "SELECT user_id, event_type AS stage, sum(round(value * 100)::BIGINT)::BIGINT AS ms, count(*) AS attempts FROM events GROUP BY 1, 2",
    "recovered_search": f"WITH {_lines(_RECOVERED)} SELECT path, line_no, line AS line_text FROM lines WHERE file_id % 20 <> 0 AND contains(line, '{RARE}')",
    "distrusted_search": """SELECT * FROM (VALUES ('known', 'index', NULL, 1::BIGINT, true), ('unknown', 'scan', 'coverage_untrusted', 2, false), ('trusted', 'index', NULL, 2, true), ('head', 'scan', 'snapshot_changed', 3, true),
  ('ref', 'scan', 'snapshot_changed', 4, true), ('listed', 'index', NULL, 4, true)) AS t(step, route, reason, generation, trusted)""",
    "overlay_generations": f"WITH {_CHANGED} SELECT path, n_bytes, (SELECT max(event_id) FROM events)::BIGINT AS generation FROM base JOIN dirty USING (path) WHERE NOT tombstone",
    "compacted_changes": f"WITH {_CHANGED} SELECT path, generation, tombstone FROM dirty",
    "fence_outcomes": """SELECT * FROM (VALUES ('none', 'rows', NULL), ('files', 'scan', 'files_changed'), ('index', 'scan', 'index_changed'), ('snapshot', 'scan', 'snapshot_changed'), ('trust', 'scan', 'coverage_untrusted'),
  ('files and index', 'scan', 'index_changed')) AS t(change, answer, reason)""",
    "gated_searches": f"SELECT n AS first, n AS second, (SELECT count(*) FROM documents) AS n_files, false AS met FROM (SELECT count(*) AS n FROM ({_literal_lines(RARE)}))",
    "repository_paths": """WITH p AS (SELECT ['/repo', '/repo/', '/other/', '', '/repository/'][(event_id % 5)::INTEGER + 1] || CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END AS path FROM events)
SELECT CASE WHEN path = '/repo' THEN '<repo>' WHEN starts_with(path, '/repo/') THEN '<repo>/' || substr(path, 7) WHEN starts_with(path, '/') THEN '<external:' || sha256(path) || '>' ELSE '<repo>/' || path END AS shown, count(*) AS n FROM p GROUP BY path""",
    "runs_read": """SELECT 'r' || event_id::VARCHAR AS run_id, CASE WHEN event_id % 100 = 1 THEN 0 ELSE 1 END AS attempt, 1 AS n_events,
  CASE event_id % 100 WHEN 1 THEN 'attempt' WHEN 2 THEN 'prompt_hash' WHEN 3 THEN 'total_ms' WHEN 4 THEN 'events' WHEN 5 THEN 'started_at' END AS invalid FROM events WHERE event_id % 100 < 7""",
    "runs_written": "SELECT event_type AS op, count(*) AS n, 4.0::DOUBLE * count(*) AS ms, true AS refused FROM events WHERE event_id % 100 IN (0, 6) GROUP BY 1",
    "glob_braces": _literal_lines(RARE, where="regexp_matches(path, '^(?:en/src1[^/]*/(?:[^/]+/)*[^/]*\\.txt|de/(?:[^/]+/)*[^/]*\\.txt)$')"),
    "glob_nested_braces": _literal_lines(RARE, where="regexp_matches(path, '(?:^|/)doc-00(?:0|10|20)[^/]*[357]\\.txt$')"),
    "regex_plain": _literal_lines(LITERAL),
    "literal_ci_non_ascii": _literal_lines(ACCENTED, fold=True),
    "regex_bounded": f"WITH {_regex_hits('[a-z]{2,4}tionsh?[ .]')} {_SHOWN}",
}
