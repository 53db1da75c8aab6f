"""Results as text: lines with their context, gaps, groups by file, size budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Row, Window
from pyspark.sql import functions as F

from .search import in_order

LINE_CHARS, OUTPUT_BYTES, NOTICE_BYTES = 500, 50 * 1024, 128
#: Fixed formats of the texts shown.
CUT, GAP, NONE = "... [truncated]", "--", "No matches found"


def display_lines(found: DataFrame) -> DataFrame:
    """path, line_no, line, is_match: each line that a result shows, once. A line that
    matches and is some other's context is a match."""
    texts = F.split("line_text", "\r?\n", -1)
    n = F.size(texts)
    numbered = lambda lines, first, hit: F.transform(
        lines, lambda l, i: F.struct((first + i).cast("long").alias("line_no"), l.alias("line"), F.lit(hit).alias("is_match"))
    )
    every = F.concat(
        numbered(F.col("before"), F.col("line_no") - F.size("before"), False), numbered(texts, F.col("line_no"), True), numbered(F.col("after"), F.col("line_no") + n, False)
    )
    each = found.select("path", F.explode(every).alias("x")).select("path", "x.*")
    return each.groupBy("path", "line_no").agg(F.max(F.struct("is_match", "line")).alias("m")).select("path", "line_no", "m.line", "m.is_match")


def context_groups(shown: DataFrame) -> DataFrame:
    """display_lines with `group_no`, counted in each file from 1: a gap opens a group."""
    order = Window.partitionBy("path").orderBy("line_no")
    gap = (F.col("line_no") > F.lag("line_no").over(order) + 1).cast("int")
    return shown.withColumn("gap", F.coalesce(gap, F.lit(0))).withColumn("group_no", (F.sum("gap").over(order) + 1).cast("long")).drop("gap")


def shortened(line: Column) -> Column:
    return F.when(F.length(line) > LINE_CHARS, F.concat(F.left(line, F.lit(LINE_CHARS)), F.lit(CUT))).otherwise(line)


def rendered(found: DataFrame) -> DataFrame:
    """path, line_no, row: `path:line: text` for a match, `path-line- text` for context,
    with a gap's mark before the first line of a later group."""
    order = Window.partitionBy("path").orderBy("line_no")
    grouped = context_groups(display_lines(found))
    mark = F.when(F.col("is_match"), ":").otherwise("-")
    text = F.concat("path", mark, F.col("line_no").cast("string"), mark, F.lit(" "), shortened(F.regexp_replace("line", "\r", "")))
    opens = F.col("group_no") > F.lag("group_no").over(order)
    return grouped.select("path", "line_no", F.when(opens, F.concat(F.lit(GAP + "\n"), text)).otherwise(text).alias("row"))


def within_budget(rows: DataFrame, budget: int = OUTPUT_BYTES - NOTICE_BYTES) -> DataFrame:
    """The first of rows(path, line_no, row), in order, that fit in so many bytes. Only
    as many rows as can fit, at a byte each at least, are looked at together."""
    first = rows.orderBy(F.encode("path", "UTF-16BE"), "line_no").limit(budget)
    order = Window.orderBy(F.encode("path", "UTF-16BE"), "line_no").rowsBetween(Window.unboundedPreceding, 0)
    return first.withColumn("bytes", F.sum(F.octet_length("row") + 1).over(order).cast("long")).where(F.col("bytes") <= budget)


def grouped_by_file(found: DataFrame) -> DataFrame:
    """path, n_matches, block: the file's path and a row for each line that matches."""
    row = F.concat(F.lit("Line "), F.col("line_no").cast("string"), F.lit(": "), F.col("line_text"))
    rows = F.array_sort(F.collect_list(F.struct("line_no", row.alias("row"))))
    return found.groupBy("path").agg(F.count("*").alias("n_matches"), F.concat_ws("\n", F.first("path"), F.transform(rows, lambda x: x["row"])).alias("block"))


def notice(displayed: int, total: int, limit: int | None) -> str | None:
    """What to tell about lines that are not shown."""
    if displayed >= total:
        return None
    return f"Showing {displayed} of {total} matches (limit {displayed if limit is None else limit}). Increase limit or narrow path/glob"


def once(result):
    """A result's lines and totals by one pass over the files: the totals are observed while the
    first lines are found, and those, up to the limit, are held. Without a limit nothing is."""
    if result.request.line_limit is None:
        return result.matches, result.totals.first()
    spark, seen = result.found.sparkSession, Observation()
    limit = result.request.line_limit
    counted = result.found.observe(seen, F.count("*").alias("lines"))
    rows = in_order(counted).limit(max(limit, 1)).collect()[:limit]
    n = seen.get["lines"] or 0
    return spark.createDataFrame(rows, result.found.schema), Row(total_matches=n, displayed=min(n, limit), truncated=n > limit)


def to_text(result) -> str:
    """A search result, up to its limit and the size budget, as text for people. The limit
    and the budget bound what reaches the driver."""
    matches, total = once(result)
    shown = rendered(matches)
    fit = within_budget(shown).select("row", "bytes").collect()
    lines = [r.row for r in fit] or [NONE]
    more = notice(total.displayed, total.total_matches, result.request.line_limit)
    if len(fit) < shown.count():
        lines += ["", f"[Output truncated at {OUTPUT_BYTES // 1024} KiB; narrow path/glob]"]
    if more:
        lines += ["", f"[{more}]"]
    reason = f", fallback={result.plan.reason}" if result.plan.reason else ""
    lines += ["", f"[search: route={result.plan.route}, matches={total.displayed}/{total.total_matches}{reason}]"]
    return "\n".join(lines)


def to_grouped_text(result, cap: int = 250) -> str:
    """Up to `cap` lines as a count and a block for each file."""
    found = result.matches.limit(cap)
    blocks = [r.block for r in grouped_by_file(found).orderBy(F.encode("path", "UTF-16BE")).collect()]
    if not blocks:
        return NONE + "."
    n = sum(b.count("\nLine ") for b in blocks)
    return f"Found {n} match{'' if n == 1 else 'es'}:\n\n" + "\n\n".join(blocks)


def oldest_files(files: DataFrame, modified: str = "modified", cap: int = 100) -> DataFrame:
    """Paths in the order of their times, the oldest first, up to `cap`."""
    return files.select("path", modified).orderBy(modified, "path").limit(cap)


def as_json(found: DataFrame) -> DataFrame:
    """A JSON object for each line that matches."""
    return found.select("path", "line_no", F.to_json(F.struct("path", "line_no", "line_text", "ranges", "before", "after")).alias("json"))
