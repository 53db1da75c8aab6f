"""The registered queries of the search engine, over the driver's tables as corpora, and
the same in SQL.

Documents are files named <lang>/<source>/doc-<id>.txt; events are a change feed (of the
document that the event's number falls to) and, by user, a trace of overlapping spans.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import globs
from .operators import compare, freshness, present, search, serving, trace
from .plans import planner
from .request import SearchRequest
from .sources import corpus, index
from .streaming import changes

LITERAL, RARE, FOLDED, ABSENT = "tion", "tionsh", "THATON", "absent_Token_xyz"
REGEX, SENTENCE = r"[A-Z][a-z]+tion", r"[a-z]\.\n[A-Z]"
SCOPE, NAME_GLOB, DEEP_GLOB = "en/src7", "doc-0000*.txt", "*/src1*/**/doc-*5.txt"
WIDTH, LIMIT = 2, 25
#: The least rows of a file of a change feed, and the most batches that a feed is taken in.
BATCH_ROWS, BATCHES = 4000, 8
LITERALS = (LITERAL, RARE, "heon", "the", "of", "::", "Inha")
_BUILT: dict[tuple, index.Index] = {}


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.document_files(spark, sf_dir)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder that the cluster names. Where none is named, in a
    temporary one, but only in a local session: a cluster's executors don't share it."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="sieveline-")
    return f"{top.rstrip('/')}/sieveline/{name}-{uuid.uuid4().hex}"


def built(spark: SparkSession, sf_dir: str) -> index.Index:
    """The index of the documents, built once a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        _BUILT[key] = index.write(files(spark, sf_dir), scratch(spark, "index"))
    return _BUILT[key]


def literal(pattern: str = LITERAL, **more) -> SearchRequest:
    return SearchRequest(pattern, literal=True, **{"limit": None} | more)


def regex(pattern: str = REGEX, **more) -> SearchRequest:
    return SearchRequest(pattern, **{"limit": None} | more)


def lines_of(found: DataFrame) -> DataFrame:
    first = F.get("ranges", F.lit(0))
    return found.select("path", "line_no", "line_text", F.size("ranges").cast("long").alias("n_ranges"), first["abs_start"].alias("abs_start"), first["line_start"].alias("line_start"))


def scanned(request: SearchRequest):
    return lambda spark, sf_dir: lines_of(search.search(request, files=files(spark, sf_dir)).found)


def indexed(request: SearchRequest):
    return lambda spark, sf_dir: lines_of(search.search(request, built(spark, sf_dir)).found)


def spans_of(request: SearchRequest):
    return lambda spark, sf_dir: search.occurrences(search.search(request, files=files(spark, sf_dir)).found)


def context_window(spark, sf_dir):
    found = search.search(literal(RARE, context=WIDTH), files=files(spark, sf_dir)).found
    return found.select("path", "line_no", "line_text", F.array_join("before", "\n").alias("before"), F.array_join("after", "\n").alias("after"))


def context_groups(spark, sf_dir):
    found = search.search(literal(RARE, context=WIDTH), files=files(spark, sf_dir)).found
    return present.context_groups(present.display_lines(found))


def render_lines(spark, sf_dir):
    return present.rendered(search.search(literal(RARE, context=WIDTH), files=files(spark, sf_dir)).found)


def render_by_file(spark, sf_dir):
    return present.grouped_by_file(search.search(literal(RARE), files=files(spark, sf_dir)).found)


def truncate_budget(spark, sf_dir):
    return present.within_budget(present.rendered(search.search(literal(RARE), files=files(spark, sf_dir)).found))


def limit_topk(spark, sf_dir):
    return lines_of(search.search(literal(limit=LIMIT), files=files(spark, sf_dir)).matches)


def limit_totals(spark, sf_dir):
    return search.search(literal(limit=LIMIT), files=files(spark, sf_dir)).totals


def files_with_matches(spark, sf_dir):
    return search.search(regex(), files=files(spark, sf_dir)).found.select("path").distinct()


def count_per_file(spark, sf_dir):
    found = search.search(literal(), files=files(spark, sf_dir)).found
    return found.groupBy("path").agg(F.count("*").alias("n_lines"), F.sum(F.size("ranges")).cast("long").alias("n_ranges"))


def universe(spark, sf_dir):
    return planner.visible(files(spark, sf_dir), SearchRequest("", glob=NAME_GLOB)).select("path")


def hidden_filter(spark, sf_dir):
    """Pages as files: those whose path has a segment that begins with a dot are hidden."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = F.regexp_replace("url", "^[a-z]+://", "")
    return pages.select(path.alias("path"), globs.is_hidden(path).alias("hidden")).groupBy("hidden").agg(F.count("*").alias("n"))


def line_offsets(spark, sf_dir):
    return corpus.lines(files(spark, sf_dir)).select("path", "line_no", "line_start", F.octet_length("line").cast("long").alias("n_bytes"))


def file_stats(spark, sf_dir):
    return corpus.with_flags(files(spark, sf_dir)).select("path", "n_bytes", "is_binary", "has_bare_cr", "has_kelvin", "has_long_s", "hidden")


def gram_postings(spark, sf_dir):
    return index.postings(files(spark, sf_dir))


def gram_df(spark, sf_dir):
    return index.frequencies(index.postings(files(spark, sf_dir)))


def rarest_gram(spark, sf_dir):
    """For several literals at once: the rarest gram, and how many grams are needed and met."""
    need = spark.createDataFrame([(p, g) for p in LITERALS for g in (planner.required_grams(literal(p)) or [None])], "pattern string, gram string")
    known = built(spark, sf_dir).grams
    each = need.join(known, "gram", "left").groupBy("pattern")
    return each.agg(F.count("gram").alias("n_needed"), F.count("df").alias("n_known"), F.min(F.when(F.col("df").isNotNull(), F.struct("df", "gram"))).alias("m")).select("pattern", "n_needed", "n_known", F.col("m.gram").alias("gram"), F.col("m.df").alias("df"))


def casefold_gram_union(spark, sf_dir):
    request = literal(FOLDED, ignore_case=True)
    own = built(spark, sf_dir)
    plan = planner.plan(request, own)
    return planner.rarest_candidates(plan, request, own).select("file_id", F.lit(plan.gram).alias("gram"))


def candidate_semi_join(spark, sf_dir):
    request, own = literal(RARE), built(spark, sf_dir)
    return own.paths.join(planner.candidates(planner.plan(request, own), request, own), "file_id", "left_semi").select("file_id", "path")


def candidate_superset_check(spark, sf_dir):
    """For each request: candidates, files that match, and matching files that are not
    candidates, of which there are none."""
    own, out = built(spark, sf_dir), None
    for name, request in (("literal", literal(RARE)), ("folded", literal(FOLDED, ignore_case=True)), ("regex", regex())):
        ids = planner.candidates(planner.plan(request, own), request, own).select("file_id", F.lit(1).alias("c"), F.lit(0).alias("v"))
        hit = search.matches(own.files, request).select("file_id").distinct().select("file_id", F.lit(0).alias("c"), F.lit(1).alias("v"))
        each = ids.unionByName(hit).groupBy("file_id").agg(F.max("c").alias("c"), F.max("v").alias("v"))
        row = each.agg(*(F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(n) for x, n in ((F.col("c"), "n_candidates"), (F.col("v"), "n_verified"), (F.col("v") * (1 - F.col("c")), "n_missed"))))
        row = row.select(F.lit(name).alias("request"), "*")
        out = row if out is None else out.unionByName(row)
    return out


REQUESTS = {
    "literal": literal(), "rare": literal(RARE), "folded": literal(FOLDED, ignore_case=True), "absent": literal(ABSENT), "no_gram": literal("::"), "short": literal("of"), "regex": regex(), "regex_no_gram": regex("[ab]+c?"),
    "multiline": regex(SENTENCE, multiline=True), "no_ignore": literal(no_ignore=True), "look_ahead": regex("a(?=b)"), "scoped": literal(path=SCOPE),
}


def route_missing_extra(spark, sf_dir):
    """Index route against full scan: for each request rows missing, extra, and in all."""
    own, out = built(spark, sf_dir), None
    for name in ("literal", "rare", "folded", "absent", "no_gram", "regex", "multiline", "scoped"):
        full = search.occurrences(search.search(REQUESTS[name], files=own.files).found)
        fast = search.occurrences(search.search(REQUESTS[name], own).found)
        both = full.select(*compare.IDENTITY, F.lit(1).alias("n")).unionByName(fast.select(*compare.IDENTITY, F.lit(-1).alias("n")))
        n = F.col("n")
        each = both.groupBy(*compare.IDENTITY).agg(F.sum("n").alias("n"))
        row = each.agg(F.count_if(n > 0).alias("missing"), F.count_if(n < 0).alias("extra"), F.count("*").alias("n_rows")).select(F.lit(name).alias("request"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def conformance_rollup(spark, sf_dir):
    each = route_missing_extra(spark, sf_dir)
    return compare.rollup(each.withColumn("status", F.when((F.col("missing") == 0) & (F.col("extra") == 0), "passed").otherwise("failed")))


def set_check(spark, sf_dir):
    return compare.is_set(spans_of(literal())(spark, sf_dir))


def match_union_dedupe(spark, sf_dir):
    a, b = (search.search(r, files=files(spark, sf_dir)).found.select("path", "line_no", "line_text") for r in (literal(RARE), regex()))
    return compare.union_once(a, b)


def universe_digest(spark, sf_dir):
    return index.digest(files(spark, sf_dir))


def folder_digests(spark, sf_dir):
    paths = files(spark, sf_dir).withColumn("folder", F.substring_index("path", "/", 2))
    return compare.digest_of(paths, ["folder"], "path")


def oldest_files(spark, sf_dir):
    """The files with the least time, which here is their length and name."""
    return present.oldest_files(files(spark, sf_dir).withColumn("modified", F.octet_length("text").cast("long")))


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change feed: path, generation, tombstone."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(_path(F.col("user_id") * 7).alias("path"), F.col("event_id").cast("long").alias("generation"), (F.col("event_type") == "error").alias("tombstone"))


def _path(number):
    return F.concat(F.lit("src/doc-"), F.lpad(F.pmod(number, F.lit(1_000_000)).cast("string"), 6, "0"), F.lit(".txt"))


def base_files(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(_path(F.col("doc_id")).alias("path"), F.octet_length("text").cast("long").alias("n_bytes"))


def dirty_set(spark, sf_dir):
    return freshness.dirty_paths(feed(spark, sf_dir))


def dirty_ack(spark, sf_dir):
    """Paths of lower half numbers are acknowledged at generation 9950."""
    dirty = dirty_set(spark, sf_dir)
    return freshness.acknowledged(dirty, dirty.where("path < 'src/doc-000350.txt'"), 9950)


def dirty_refresh(spark, sf_dir):
    """A listing of changes that began at generation 9960 replaces older paths."""
    listed = base_files(spark, sf_dir).where("n_bytes < 100").select("path", F.lit(False).alias("tombstone"))
    return freshness.merged_with(dirty_set(spark, sf_dir), listed, 9960, 1_000_000_000, replace=True)


def overlay_merge(spark, sf_dir):
    overlay = base_files(spark, sf_dir).withColumn("n_bytes", F.col("n_bytes") + 1)
    return freshness.current_files(base_files(spark, sf_dir), overlay, dirty_set(spark, sf_dir))


def tombstone_anti_join(spark, sf_dir):
    return base_files(spark, sf_dir).join(dirty_set(spark, sf_dir).where("tombstone"), "path", "left_anti")


def dirty_stream(spark, sf_dir):
    """The dirty set as a stream leaves it, in several batches. A batch costs a second or so
    whatever it holds, so batches grow with the feed, in files for every core, and not their number."""
    at, own = scratch(spark, "changes"), feed(spark, sf_dir)
    rows = max(BATCH_ROWS, -(-own.count() // (BATCHES * spark.sparkContext.defaultParallelism)))
    own.write.option("maxRecordsPerFile", rows).parquet(f"{at}/feed")
    n = len(index.names(spark, f"{at}/feed", r"part-(\d+).*\.parquet"))
    events = spark.readStream.schema(changes.EVENT).option("maxFilesPerTrigger", max(1, -(-n // BATCHES))).parquet(f"{at}/feed")
    table = changes.DirtyTable(spark, f"{at}/table")
    changes.follow(events, table, f"{at}/checkpoint").awaitTermination()
    return table.read()


def spans(spark, sf_dir) -> DataFrame:
    """run_id, op, start_ms, end_ms of events, as spans of `value` minutes."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    start = (F.unix_micros(F.col("ts").cast("timestamp")) / 1000 - F.lit(1704067200000.0)).cast("double")
    return events.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("op"), start.alias("start_ms"), (start + F.round(F.col("value") * 60000)).alias("end_ms")).withColumns(
        {"duration_ms": F.col("end_ms") - F.col("start_ms"), "status": F.when(F.col("op") == "error", "error").otherwise("ok")}
    )


def event_islands(spark, sf_dir):
    return trace.islands(spans(spark, sf_dir))


def event_gap_complement(spark, sf_dir):
    own = spans(spark, sf_dir)
    return trace.gaps(own, own.groupBy("run_id").agg(F.max("end_ms").alias("total_ms")))


def event_timeline(spark, sf_dir):
    own = spans(spark, sf_dir)
    lined = trace.timeline(own, own.groupBy("run_id").agg(F.max("end_ms").alias("total_ms")))
    return lined.groupBy("run_id", "op").agg(F.count("*").alias("n"), F.round(F.sum("duration_ms"), 3).alias("total_ms"))


def tool_pairing(spark, sf_dir):
    """Views start and purchases end a call of their user and day; what doesn't pair is
    named."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type IN ('view', 'purchase')")
    phase = F.when(F.col("event_type") == "view", "start").otherwise("end")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1000
    marks = e.select(F.col("user_id").alias("run_id"), F.to_date("ts").cast("string").alias("tool_call_id"), F.lit("read").alias("tool"), phase.alias("phase"), at.alias("at_ms"), F.lit(False).alias("is_error"))
    return trace.paired(marks).select("run_id", "tool_call_id", "op", "status", "problem", F.round("duration_ms", 3).alias("duration_ms"))


def latency_percentiles(spark, sf_dir):
    return trace.latency(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", "value")


def usage_rollup(spark, sf_dir):
    """Characters of conversations as tokens: input of users, output of assistants."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    n = F.length("text").cast("double")
    of = lambda role: F.when(F.col("role") == role, n).otherwise(F.lit(0.0))
    none = F.lit(None).cast("double")
    messages = turns.select(
        F.col("conv_id").alias("run_id"), of("user").alias("input"), of("assistant").alias("output"), F.lit(0.0).alias("cache_read"), of("system").alias("cache_write"),
        F.when(F.col("role") == "assistant", n).alias("reasoning"), F.lit(0.0).alias("total_tokens"), none.alias("cost_total"),
    )
    return trace.usage(messages)


def argument_signatures(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    arguments = F.create_map(F.lit("pattern"), F.col("event_type"), F.lit("path"), F.concat(F.lit("user/"), F.col("user_id").cast("string")))
    sign = trace.signature(arguments)
    return e.select(sign.alias("s")).groupBy(F.col("s.pattern_hash").alias("pattern_hash"), F.col("s.path_hash").alias("path_hash")).agg(F.count("*").alias("n"), F.array_join(F.min("s.argument_keys"), ",").alias("argument_keys"))


def benchmark_search(spark, sf_dir):
    """The benchmark table as a corpus of its own."""
    own = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("file_id"), F.concat(F.lit("item/"), F.col("item_id").cast("string")).alias("path"), "text")
    return lines_of(search.search(literal(), files=own).found)


def next_page(spark, sf_dir):
    """The second page of 25 lines, and the sign of a third."""
    found = search.search(literal(), files=files(spark, sf_dir)).found
    last = search.in_order(found).limit(LIMIT).select("path", "line_no").collect()
    return serving.page(found, LIMIT, tuple(last[-1]) if last else None).select("path", "line_no", "is_more")


def path_lookup(spark, sf_dir):
    """Files of the paths that a listing names, of which some don't exist."""
    named = feed(spark, sf_dir).select("path")
    docs = base_files(spark, sf_dir).select("path", F.xxhash64("path").alias("file_id"))
    return serving.looked_up(named, docs).select("path", "n_files")


def current_search(spark, sf_dir):
    """A search over the index with changes: every tenth document is dirty, every
    twentieth gone, and the others have a line more."""
    own = built(spark, sf_dir)
    dirty = own.files.where("file_id % 10 = 0").select("path", F.lit(1).cast("long").alias("generation"), (F.col("file_id") % 20 == 0).alias("tombstone"))
    changed = own.files.where("file_id % 10 = 0").withColumn("text", F.concat(F.lit(RARE + " new\n"), "text"))
    return serving.search_current(literal(RARE), own, changed, dirty).select("path", "line_no", "line_text")


def pages_search(spark, sf_dir):
    own = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("file_id"), F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("path"), F.col("html").alias("text"))
    return search.occurrences(search.search(literal("</p>"), files=own).found)


QUERIES = {
    "literal_lines": scanned(literal()), "literal_lines_indexed": indexed(literal()), "literal_rare_indexed": indexed(literal(RARE)), "literal_absent": indexed(literal(ABSENT)), "literal_occurrences": spans_of(literal()),
    "literal_ci": scanned(literal(FOLDED, ignore_case=True)), "literal_ci_indexed": indexed(literal(FOLDED, ignore_case=True)), "path_scope": scanned(literal(path=SCOPE)), "glob_basename": scanned(literal(glob=NAME_GLOB)),
    "glob_recursive": scanned(literal(glob=DEEP_GLOB)), "glob_negated": scanned(literal(RARE, glob="!" + NAME_GLOB)), "hidden_filter": hidden_filter, "universe_listing": universe, "regex_lines": scanned(regex()),
    "regex_lines_indexed": indexed(regex()), "regex_occurrences": spans_of(regex()), "regex_alternation": spans_of(regex("(?:the|und|que) [a-z]+e")), "regex_ignore_case": scanned(regex("^in[a-z]*tion", ignore_case=True)),
    "multiline_match": spans_of(regex(SENTENCE, multiline=True)), "context_window": context_window, "context_groups": context_groups, "limit_topk": limit_topk, "limit_totals": limit_totals, "files_with_matches": files_with_matches,
    "count_per_file": count_per_file, "gram_postings": gram_postings, "gram_df": gram_df, "rarest_gram": rarest_gram, "casefold_gram_union": casefold_gram_union, "candidate_semi_join": candidate_semi_join,
    "candidate_superset_check": candidate_superset_check, "overlay_merge": overlay_merge, "tombstone_anti_join": tombstone_anti_join, "match_union_dedupe": match_union_dedupe, "route_missing_extra": route_missing_extra,
    "conformance_rollup": conformance_rollup, "set_check": set_check, "line_offsets": line_offsets, "file_stats": file_stats, "universe_digest": universe_digest, "folder_digests": folder_digests, "event_islands": event_islands,
    "event_gap_complement": event_gap_complement, "event_timeline": event_timeline, "tool_pairing": tool_pairing, "latency_percentiles": latency_percentiles, "usage_rollup": usage_rollup, "argument_signatures": argument_signatures,
    "dirty_set": dirty_set, "dirty_ack": dirty_ack, "dirty_refresh": dirty_refresh, "dirty_stream": dirty_stream, "oldest_files": oldest_files, "render_lines": render_lines, "render_by_file": render_by_file,
    "truncate_budget": truncate_budget, "benchmark_search": benchmark_search, "pages_search": pages_search,
    "next_page": next_page, "path_lookup": path_lookup, "current_search": current_search,
}

_FILES = """files AS (
  SELECT doc_id AS file_id, lang || '/' || source || '/doc-' || CASE WHEN length(doc_id::VARCHAR) > 6 THEN doc_id::VARCHAR ELSE lpad(doc_id::VARCHAR, 6, '0') END || '.txt' AS path, text
  FROM documents)"""


def _lines(of: str = _FILES) -> str:
    return f"""{of},
split AS (SELECT file_id, path, CASE WHEN text = '' OR right(text, 1) = chr(10) THEN s[1:len(s) - 1] ELSE s END AS s FROM (SELECT *, string_split(text, chr(10)) AS s FROM files)),
lines AS (
  SELECT file_id, path, i AS line_no, s[i] AS line,
    coalesce(sum(strlen(s[i]) + 1) OVER (PARTITION BY file_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS line_at, len(s) AS n
  FROM split, unnest(range(1, len(s) + 1)) AS t(i))"""


def _literal_hits(pattern: str, where: str = "true", fold: bool = False, of: str = _FILES) -> str:
    line = "lower(line)" if fold else "line"
    text = pattern.lower() if fold else pattern
    return f"""{_lines(of)},
hits AS (
  SELECT path, line_no, line, line_at, n, (len(p) - 1)::BIGINT AS n_ranges, strlen(p[1])::BIGINT AS line_start, p
  FROM (SELECT *, string_split({line}, '{text}') AS p FROM lines WHERE {where}) WHERE len(p) > 1)"""


def _regex_hits(pattern: str, flags: str = "") -> str:
    return f"""{_lines()},
hits AS (
  SELECT path, line_no, line, line_at, len(h)::BIGINT AS n_ranges, strlen(p[1])::BIGINT AS line_start, p, h
  FROM (SELECT *, regexp_extract_all(line, '{flags}{pattern}') AS h, regexp_split_to_array(line, '{flags}{pattern}') AS p FROM lines) WHERE len(h) > 0)"""


_SHOWN = "SELECT path, line_no, line AS line_text, n_ranges, line_at + line_start AS abs_start, line_start FROM hits"


def _literal_lines(*args, **more) -> str:
    return f"WITH {_literal_hits(*args, **more)} {_SHOWN}"


def _literal_spans(pattern: str, **more) -> str:
    n = len(pattern.encode())
    return f"""WITH {_literal_hits(pattern, **more)}, starts AS (SELECT path, line_at + strlen(array_to_string(p[1:k], '{pattern}')) AS abs_start FROM hits, unnest(range(1, len(p))) AS t(k))
SELECT path, abs_start, abs_start + {n} AS abs_end FROM starts"""


def _regex_spans(pattern: str) -> str:
    return f"""WITH {_regex_hits(pattern)}, starts AS (
  SELECT path, line_at + strlen(array_to_string(p[1:k], '')) + strlen(array_to_string(h[1:k - 1], '')) AS abs_start, strlen(h[k]) AS n FROM hits, unnest(range(1, len(h) + 1)) AS t(k))
SELECT path, abs_start, abs_start + n AS abs_end FROM starts"""


_GRAMS = """tokens AS (SELECT file_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]{3,}')) AS w FROM files),
postings AS (SELECT DISTINCT substr(w, i, 3) AS gram, file_id FROM tokens, unnest(range(1, length(w) - 1)) AS t(i))"""


def _needed(pattern: str) -> str:
    return ", ".join(f"('{pattern}', '{g}')" for g in planner.required_grams(literal(pattern))) or f"('{pattern}', NULL)"


def _having(grams, fold: bool = False) -> str:
    """Ids of the files that have all of these grams."""
    gram = "lower(gram)" if fold else "gram"
    return f"SELECT file_id FROM postings WHERE {gram} IN ({', '.join(repr(g) for g in grams)}) GROUP BY file_id HAVING count(DISTINCT {gram}) = {len(grams)}"


_CONTEXT = f"""WITH {_lines()}, shown AS (
  SELECT *, contains(line, '{RARE}') AS hit FROM lines),
near AS (SELECT *, max(hit) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN {WIDTH} PRECEDING AND {WIDTH} FOLLOWING) AS near FROM shown),
kept AS (SELECT path, line_no, line, hit AS is_match FROM near WHERE near),
grouped AS (
  SELECT path, line_no, line, is_match, (sum(CASE WHEN line_no > prev + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line_no) + 1)::BIGINT AS group_no
  FROM (SELECT *, lag(line_no) OVER (PARTITION BY path ORDER BY line_no) AS prev FROM kept))"""
_CUT = "CASE WHEN length(line) > 500 THEN left(line, 500) || '... [truncated]' ELSE line END"
_PATH = "'src/doc-' || lpad((({0}) % 1000000)::VARCHAR, 6, '0') || '.txt'"
_DIRTY = f"""dirty AS (
  SELECT path, max(generation) AS generation, arg_max(tombstone, generation) AS tombstone
  FROM (SELECT {_PATH.format("user_id * 7")} AS path, event_id::BIGINT AS generation, event_type = 'error' AS tombstone FROM events) GROUP BY path),
base AS (SELECT {_PATH.format("doc_id")} AS path, strlen(text)::BIGINT AS n_bytes FROM documents)"""
_SPANS = """spans AS (
  SELECT user_id AS run_id, event_type AS op, epoch_us(ts) / 1000 - 1704067200000.0 AS start_ms, epoch_us(ts) / 1000 - 1704067200000.0 + round(value * 60000) AS end_ms FROM events),
reached AS (SELECT *, max(end_ms) OVER (PARTITION BY run_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans),
gap AS (SELECT run_id, greatest(coalesce(reach, 0), 0)::DOUBLE AS start_ms, start_ms AS end_ms FROM reached
  WHERE start_ms > greatest(coalesce(reach, 0), 0) AND NOT abs(start_ms - greatest(coalesce(reach, 0), 0)) <= 1e-6 * greatest(1, abs(start_ms), abs(reach)))"""
_SHA = "sha256({0})"


def _route_counts() -> str:
    counts = {
        "literal": _literal_spans(LITERAL), "rare": _literal_spans(RARE), "folded": _literal_spans(FOLDED.lower(), fold=True), "absent": _literal_spans(ABSENT), "no_gram": _literal_spans("::"), "regex": _regex_spans(REGEX),
        "multiline": f"WITH {_FILES} SELECT unnest(regexp_extract_all(text, '{SENTENCE}')) FROM files", "scoped": _literal_spans(LITERAL, where=f"starts_with(path, '{SCOPE}/')"),
    }
    return " UNION ALL ".join(f"SELECT '{name}' AS request, 0::BIGINT AS missing, 0::BIGINT AS extra, (SELECT count(*) FROM ({sql})) AS n_rows" for name, sql in counts.items())


def _candidates(name: str, grams, hit: str, fold: bool = False) -> str:
    return f"""SELECT '{name}' AS request, count(*) FILTER (c) AS n_candidates, count(*) FILTER (v) AS n_verified, count(*) FILTER (v AND NOT c) AS n_missed FROM (
  SELECT file_id, {hit} AS v, file_id IN ({_having(grams, fold)}) AS c FROM files)"""


ORACLE = {
    "literal_lines": _literal_lines(LITERAL),
    "literal_lines_indexed": _literal_lines(LITERAL),
    "literal_rare_indexed": _literal_lines(RARE),
    "literal_absent": _literal_lines(ABSENT),
    "literal_occurrences": _literal_spans(LITERAL),
    "literal_ci": _literal_lines(FOLDED, fold=True),
    "literal_ci_indexed": _literal_lines(FOLDED, fold=True),
    "path_scope": _literal_lines(LITERAL, where=f"starts_with(path, '{SCOPE}/')"),
    "glob_basename": _literal_lines(LITERAL, where="regexp_matches(path, '^(?:.*/)?doc-0000[^/]*\\.txt$')"),
    "glob_recursive": _literal_lines(LITERAL, where="regexp_matches(path, '^[^/]*/src1[^/]*/(?:[^/]+/)*doc-[^/]*5\\.txt$')"),
    "glob_negated": _literal_lines(RARE, where="NOT regexp_matches(path, '^(?:.*/)?doc-0000[^/]*\\.txt$')"),
    "hidden_filter": "SELECT regexp_matches(regexp_replace(url, '^[a-z]+://', ''), '(^|/)\\.') AS hidden, count(*) AS n FROM pages GROUP BY 1",
    "universe_listing": f"WITH {_FILES} SELECT path FROM files WHERE regexp_matches(path, '^(?:.*/)?doc-0000[^/]*\\.txt$')",
    "regex_lines": f"WITH {_regex_hits(REGEX)} {_SHOWN}",
    "regex_lines_indexed": f"WITH {_regex_hits(REGEX)} {_SHOWN}",
    "regex_occurrences": _regex_spans(REGEX),
    "regex_alternation": _regex_spans("(?:the|und|que) [a-z]+e"),
    "regex_ignore_case": f"WITH {_regex_hits('^in[a-z]*tion', '(?i)')} {_SHOWN}",
    "multiline_match": f"""WITH {_FILES}, m AS (SELECT path, regexp_extract_all(text, '{SENTENCE}') AS h, regexp_split_to_array(text, '{SENTENCE}') AS p FROM files),
starts AS (SELECT path, strlen(array_to_string(p[1:k], '')) + strlen(array_to_string(h[1:k - 1], '')) AS abs_start, strlen(h[k]) AS n FROM m, unnest(range(1, len(h) + 1)) AS t(k))
SELECT path, abs_start, abs_start + n AS abs_end FROM starts""",
    "context_window": f"""WITH {_lines()}, w AS (
  SELECT path, line_no, line, list(line) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN {WIDTH} PRECEDING AND 1 PRECEDING) AS b,
    list(line) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND {WIDTH} FOLLOWING) AS a FROM lines)
SELECT path, line_no, line AS line_text, coalesce(array_to_string(b, chr(10)), '') AS before, coalesce(array_to_string(a, chr(10)), '') AS after FROM w WHERE contains(line, '{RARE}')""",
    "context_groups": f"{_CONTEXT} SELECT path, line_no, line, is_match, group_no FROM grouped",
    "render_lines": f"""{_CONTEXT} SELECT path, line_no, CASE WHEN group_no > lag(group_no) OVER (PARTITION BY path ORDER BY line_no) THEN '--' || chr(10) ELSE '' END ||
  path || CASE WHEN is_match THEN ':' ELSE '-' END || line_no::VARCHAR || CASE WHEN is_match THEN ':' ELSE '-' END || ' ' || {_CUT} AS row FROM grouped""",
    "render_by_file": f"""WITH {_literal_hits(RARE)} SELECT path, count(*) AS n_matches, path || chr(10) || string_agg('Line ' || line_no::VARCHAR || ': ' || line, chr(10) ORDER BY line_no) AS block FROM hits GROUP BY path""",
    "truncate_budget": f"""WITH {_literal_hits(RARE)}, rows AS (
  SELECT path, line_no, CASE WHEN line_no > lag(line_no) OVER (PARTITION BY path ORDER BY line_no) + 1 THEN '--' || chr(10) ELSE '' END || path || ':' || line_no::VARCHAR || ': ' || {_CUT} AS row FROM hits),
summed AS (SELECT *, sum(strlen(row) + 1) OVER (ORDER BY path, line_no)::BIGINT AS bytes FROM rows)
SELECT path, line_no, row, bytes FROM summed WHERE bytes <= {present.OUTPUT_BYTES - present.NOTICE_BYTES}""",
    "limit_topk": f"{_literal_lines(LITERAL)} ORDER BY path, line_no LIMIT {LIMIT}",
    "limit_totals": f"""WITH {_literal_hits(LITERAL)} SELECT count(*) AS total_matches, coalesce(sum(n_ranges), 0)::BIGINT AS total_occurrences, count(DISTINCT path) AS n_files,
  least(count(*), {LIMIT})::BIGINT AS displayed, count(*) > {LIMIT} AS truncated FROM hits""",
    "files_with_matches": f"WITH {_FILES} SELECT DISTINCT path FROM files WHERE regexp_matches(text, '{REGEX}')",
    "count_per_file": f"WITH {_literal_hits(LITERAL)} SELECT path, count(*) AS n_lines, sum(n_ranges)::BIGINT AS n_ranges FROM hits GROUP BY path",
    "gram_postings": f"WITH {_FILES}, {_GRAMS} SELECT gram, file_id FROM postings",
    "gram_df": f"WITH {_FILES}, {_GRAMS} SELECT gram, (ascii(gram[1]) * 65536 + ascii(gram[2]) * 256 + ascii(gram[3]))::INTEGER AS gram_key, lower(gram) AS folded, count(*) AS df FROM postings GROUP BY gram",
    "rarest_gram": f"""WITH {_FILES}, {_GRAMS}, df AS (SELECT gram, count(*) AS df FROM postings GROUP BY gram), need(pattern, gram) AS (VALUES {", ".join(map(_needed, LITERALS))})
SELECT pattern, count(need.gram) AS n_needed, count(df) AS n_known, arg_min(df.gram, (df, df.gram)) AS gram, min(df) AS df FROM need LEFT JOIN df ON df.gram = need.gram GROUP BY pattern""",
    "casefold_gram_union": f"""WITH {_FILES}, {_GRAMS}, f AS (SELECT lower(gram) AS g, count(*) AS df FROM postings WHERE lower(gram) IN ({", ".join(f"'{g}'" for g in planner.required_grams(literal(FOLDED, ignore_case=True)))}) GROUP BY 1),
one AS (SELECT g FROM f ORDER BY df, g LIMIT 1) SELECT DISTINCT file_id, g AS gram FROM postings JOIN one ON lower(gram) = g""",
    "candidate_semi_join": f"WITH {_FILES}, {_GRAMS} SELECT file_id, path FROM files WHERE file_id IN ({_having(planner.required_grams(literal(RARE)))})",
    "candidate_superset_check": f"WITH {_FILES}, {_GRAMS} "
    + " UNION ALL ".join(
        [
            _candidates("literal", list(planner.required_grams(literal(RARE))), f"contains(text, '{RARE}')"),
            _candidates("folded", list(planner.required_grams(literal(FOLDED, ignore_case=True))), f"contains(lower(text), '{FOLDED.lower()}')", True),
            _candidates("regex", list(planner.required_grams(regex())), f"regexp_matches(text, '{REGEX}')"),
        ]
    ),
    "overlay_merge": f"""WITH {_DIRTY} SELECT path, n_bytes FROM base WHERE path NOT IN (SELECT path FROM dirty)
UNION ALL SELECT path, n_bytes + 1 FROM base WHERE path IN (SELECT path FROM dirty WHERE NOT tombstone)""",
    "tombstone_anti_join": f"WITH {_DIRTY} SELECT path, n_bytes FROM base WHERE path NOT IN (SELECT path FROM dirty WHERE tombstone)",
    "match_union_dedupe": f"WITH {_lines()} SELECT path, line_no, line AS line_text FROM lines WHERE contains(line, '{RARE}') OR regexp_matches(line, '{REGEX}')",
    "route_missing_extra": _route_counts(),
    "conformance_rollup": "SELECT 8::BIGINT AS n_queries, 0::BIGINT AS n_failed, 0::BIGINT AS n_errors, 0::BIGINT AS n_missing, 0::BIGINT AS n_extra, true AS passed",
    "set_check": f"SELECT count(*) AS n_rows, count(*) AS n_keys, true AS \"unique\" FROM ({_literal_spans(LITERAL)})",
    "line_offsets": f"WITH {_lines()} SELECT path, line_no, line_at AS line_start, strlen(line)::BIGINT AS n_bytes FROM lines",
    "file_stats": f"""WITH {_FILES} SELECT path, strlen(text)::BIGINT AS n_bytes, contains(text, chr(0)) AS is_binary, contains(replace(text, chr(13) || chr(10), ''), chr(13)) AS has_bare_cr,
  contains(text, chr(8490)) AS has_kelvin, contains(text, chr(383)) AS has_long_s, regexp_matches(path, '(^|/)\\.') AS hidden FROM files""",
    "universe_digest": f"""WITH {_FILES} SELECT count(*) AS n_files, sum(strlen(text))::BIGINT AS n_bytes,
  (sum(('0x' || substr(sha256(strlen(path)::VARCHAR || '|' || path || '|' || strlen(text)::VARCHAR || '|' || sha256(text)), 1, 13))::BIGINT) % 1000000000000000000)::BIGINT AS digest FROM files""",
    "folder_digests": f"""WITH {_FILES}, f AS (SELECT lang || '/' || source AS folder, strlen(path)::VARCHAR || ':' || path AS v FROM files JOIN documents ON doc_id = file_id)
SELECT folder, count(*) AS n, (sum(('0x' || substr(sha256(v), 1, 13))::BIGINT) % 1000000000000000000)::BIGINT AS digest FROM f GROUP BY folder""",
    "event_islands": f"""WITH {_SPANS}, n AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ms > reach THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS island FROM reached)
SELECT run_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM n GROUP BY run_id, island""",
    "event_gap_complement": f"WITH {_SPANS} SELECT run_id, start_ms, end_ms, end_ms - start_ms AS duration_ms FROM gap",
    "event_timeline": f"""WITH {_SPANS}, every AS (SELECT run_id, op, end_ms - start_ms AS d FROM spans UNION ALL SELECT run_id, 'thinking', end_ms - start_ms FROM gap)
SELECT run_id, op, count(*) AS n, round(sum(d), 3) AS total_ms FROM every GROUP BY run_id, op""",
    "tool_pairing": """WITH m AS (
  SELECT user_id AS run_id, ts::DATE::VARCHAR AS tool_call_id, count(*) FILTER (event_type = 'view') AS s, count(*) FILTER (event_type = 'purchase') AS e,
    min(epoch_us(ts) / 1000) FILTER (event_type = 'view') AS a, max(epoch_us(ts) / 1000) FILTER (event_type = 'purchase') AS b FROM events WHERE event_type IN ('view', 'purchase') GROUP BY 1, 2)
SELECT run_id, tool_call_id, CASE WHEN s = 0 THEN 'tool' ELSE 'read' END AS op, CASE WHEN e = 0 THEN 'aborted' ELSE 'ok' END AS status,
  CASE WHEN s = 0 THEN 'orphan_end' WHEN s > 1 THEN 'duplicate_start' WHEN e > 1 THEN 'duplicate_end' WHEN b < a THEN 'ends_before_start' END AS problem, round(b - a, 3) AS duration_ms FROM m""",
    "latency_percentiles": """SELECT event_type, count(value) AS n, min(value) AS min_ms, max(value) AS max_ms, round(avg(value), 6) AS mean_ms, round(quantile_cont(value, 0.5), 6) AS p50_ms,
  round(quantile_cont(value, 0.95), 6) AS p95_ms FROM events GROUP BY event_type""",
    "usage_rollup": """WITH m AS (SELECT conv_id, role, length(text)::DOUBLE AS n FROM conversations)
SELECT conv_id AS run_id, sum(CASE WHEN role = 'user' THEN n ELSE 0 END) AS input, sum(CASE WHEN role = 'assistant' THEN n ELSE 0 END) AS output, 0.0::DOUBLE AS cache_read,
  sum(CASE WHEN role = 'system' THEN n ELSE 0 END) AS cache_write, sum(CASE WHEN role IN ('user', 'assistant', 'system') THEN n ELSE 0 END) AS total_tokens,
  sum(CASE WHEN role = 'assistant' THEN n END) AS reasoning, NULL::DOUBLE AS cost_total FROM m GROUP BY conv_id""",
    "argument_signatures": "SELECT sha256(event_type) AS pattern_hash, sha256('user/' || user_id::VARCHAR) AS path_hash, count(*) AS n, 'path,pattern' AS argument_keys FROM events GROUP BY event_type, user_id",
    "dirty_set": f"WITH {_DIRTY} SELECT path, generation, tombstone FROM dirty",
    "dirty_stream": f"WITH {_DIRTY} SELECT path, generation, tombstone FROM dirty",
    "dirty_ack": f"WITH {_DIRTY} SELECT path, generation, tombstone FROM dirty WHERE NOT (path < 'src/doc-000350.txt' AND generation <= 9950)",
    "dirty_refresh": f"""WITH {_DIRTY}, every AS (SELECT path, generation, tombstone FROM dirty WHERE generation > 9960 UNION ALL SELECT path, 1000000000, false FROM base WHERE n_bytes < 100)
SELECT path, max(generation) AS generation, arg_max(tombstone, generation) AS tombstone FROM every GROUP BY path""",
    "oldest_files": f"WITH {_FILES} SELECT path, strlen(text)::BIGINT AS modified FROM files ORDER BY modified, path LIMIT 100",
    "benchmark_search": _literal_lines(LITERAL, of="files AS (SELECT item_id AS file_id, 'item/' || item_id::VARCHAR AS path, text FROM benchmark)"),
    "pages_search": _literal_spans("</p>", of="files AS (SELECT page_id AS file_id, 'page/' || page_id::VARCHAR AS path, html AS text FROM pages)"),
    "next_page": f"""WITH {_literal_hits(LITERAL)}, r AS (SELECT path, line_no, row_number() OVER (ORDER BY path, line_no) AS k FROM hits)
SELECT path, line_no, k > {2 * LIMIT} AS is_more FROM r WHERE k > {LIMIT} AND k <= {2 * LIMIT + 1}""",
    "path_lookup": f"WITH {_DIRTY} SELECT d.path, count(b.path) AS n_files FROM dirty d LEFT JOIN base b ON b.path = d.path GROUP BY d.path",
    "current_search": f"""WITH {_lines(_FILES.replace("text", f"CASE WHEN doc_id % 10 = 0 THEN '{RARE} new' || chr(10) || text ELSE text END AS text", 1))}
SELECT path, line_no, line AS line_text FROM lines WHERE file_id % 20 <> 0 AND contains(line, '{RARE}')""",
}
