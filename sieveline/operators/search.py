"""Line search: matching lines with exact byte ranges, context, order, limit and totals.

All is done within a file's row: the lines that match are found in the array of lines, and
only those leave it, with their neighbours. So a search has no shuffle but for the final
order, which with a limit is a top-k.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import regexes
from ..functions.arrays import running_starts
from ..plans import planner
from ..request import SearchRequest
from ..sources.corpus import EARLY, split_lines
from ..sources.index import Index

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MATCH = "array<struct<line_no:bigint,line_text:string,line_at:bigint,ranges:array<struct<line_start:bigint,line_end:bigint>>,before:array<string>,after:array<string>>>"
OPENED, CLOSED = "\ufdd0", "\ufdd1"  # noncharacters


@dataclass(frozen=True)
class Pattern:
    """A request's pattern on columns. found: whether a text holds it; parts: the text cut
    into what lies before each match (`gap`) and the match (`hit`, null at the end)."""

    found: object
    parts: object

    def ranges(self, text: Column) -> Column:
        return _running(self.parts(text))


def _quoted(text: str) -> str:
    return "".join(f"\\x{{{ord(c):x}}}" if not (c.isalnum() and c.isascii()) else c for c in text)


def _hit_size(x: Column) -> Column:
    return F.coalesce(F.octet_length(x["hit"]), F.lit(0))


def _starts(parts: Column, size) -> Column:
    """Where each part begins, counted in `size`."""
    return running_starts(F.transform(parts, lambda x: (size(x["gap"]) + F.coalesce(size(x["hit"]), F.lit(0))).cast("long")))


def _running(parts: Column) -> Column:
    """Byte ranges of the matches."""

    def placed(x, at):
        first = at + F.octet_length(x["gap"])
        return F.struct(first.cast("long").alias("line_start"), (first + _hit_size(x)).cast("long").alias("line_end"), x["hit"].isNotNull().alias("is_hit"))

    hits = F.filter(F.zip_with(parts, _starts(parts, F.octet_length), placed), lambda r: r["is_hit"])
    return F.transform(hits, lambda r: F.struct(r["line_start"].alias("line_start"), r["line_end"].alias("line_end")))


def regex_parts(text: Column, java: str, empty: bool) -> Column:
    """Where matches may be empty, they are marked in the text and the marks split it; else
    what lies between matches and the matches alternate."""
    if empty:
        marked = F.split(F.regexp_replace(text, java, f"{OPENED}$0{CLOSED}"), f"[{OPENED}{CLOSED}]", -1)
        return F.arrays_zip(F.filter(marked, lambda x, i: i % 2 == 0).alias("gap"), F.filter(marked, lambda x, i: i % 2 == 1).alias("hit"))
    return F.arrays_zip(F.split(text, java, -1).alias("gap"), F.regexp_extract_all(text, F.lit(java), F.lit(0)).alias("hit"))


def literal_parts(text: Column, literal: str) -> Column:
    """Leftmost, non-overlapping; a gap that another follows is followed by a match."""
    gaps = F.split(text, _quoted(literal), -1)
    return F.zip_with(gaps, F.slice(gaps, 2, 2**30), lambda g, after: F.struct(g.alias("gap"), F.when(after.isNotNull(), F.lit(literal)).alias("hit")))


def fold(text: Column) -> Column:
    """ASCII letters in lower case; lengths in bytes don't change."""
    return F.translate(text, UPPER, LOWER)


def compiled(request: SearchRequest) -> Pattern:
    if not request.literal and not request.ignore_case and not request.multiline and (text := regexes.plain(request.pattern)):
        # a regex that stands for a string is found as one
        return Pattern(lambda t: t.contains(text), lambda t: literal_parts(t, text))
    if request.literal and not request.ignore_case:
        return Pattern(lambda t: t.contains(request.pattern), lambda t: literal_parts(t, request.pattern))
    if request.literal and request.pattern.isascii() and not set(request.pattern.lower()) & set("ks"):
        low = request.pattern.lower()
        return Pattern(lambda t: fold(t).contains(low), lambda t: literal_parts(fold(t), low))
    if request.literal:
        java, empty = f"(?iu){_quoted(request.pattern)}", not request.pattern
    else:
        java = regexes.to_java(request.pattern, request.ignore_case)
        empty = regexes.nullable(regexes.parse(request.pattern, request.ignore_case))
    return Pattern(lambda t: t.rlike(java), lambda t: regex_parts(t, java, empty))


def _line_matches(request: SearchRequest) -> Column:
    pattern = compiled(request)
    lines = F.col("lines")
    placed = F.zip_with(lines, F.col("line_starts"), lambda l, at: F.struct(l.alias("l"), at.alias("at")))
    numbered = F.filter(F.transform(placed, lambda x, i: F.struct(x["l"].alias("l"), x["at"].alias("at"), i.alias("i"))), lambda x: pattern.found(x["l"]))
    b, a = request.before, request.after
    none = F.array().cast("array<string>")
    strip = lambda l: F.regexp_replace(l, "\r$", "")

    def made(x):
        i = x["i"]
        before = F.transform(F.slice(lines, F.greatest(i - b, F.lit(0)) + 1, F.least(i, F.lit(b))), strip) if b else none
        after = F.transform(F.slice(lines, i + 2, F.lit(a)), strip) if a else none
        return F.struct(
            (i + 1).cast("long").alias("line_no"), strip(x["l"]).alias("line_text"), x["at"].alias("line_at"), pattern.ranges(x["l"]).alias("ranges"), before.alias("before"), after.alias("after")
        )

    return F.transform(numbered, made).cast(MATCH)


def _block_matches(request: SearchRequest) -> Column:
    """Matches over line ends: each is placed by the feeds before it."""
    pattern = compiled(request)
    lines = F.col("lines")
    b, a = request.before, request.after
    none = F.array().cast("array<string>")
    feeds = lambda t: F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))
    parts = pattern.parts(F.col("text"))
    whole = F.arrays_zip(parts.alias("part"), _starts(parts, F.octet_length).alias("at"), _starts(parts, feeds).alias("fed"))

    def placed(x):
        gap, hit = x["part"]["gap"], x["part"]["hit"]
        start = x["at"] + F.octet_length(gap)
        # a last feed of the match ends its last line and opens none
        n = feeds(F.regexp_replace(hit, "\n$", "")) + 1
        return F.struct(start.alias("start"), F.octet_length(hit).alias("size"), (x["fed"] + feeds(gap)).cast("int").alias("i"), n.cast("int").alias("n"))

    def made(x):
        i, n, at = x["i"], x["n"], F.get(F.col("line_starts"), x["i"])
        inner = F.struct((x["start"] - at).alias("line_start"), (x["start"] - at + x["size"]).alias("line_end"))
        return F.struct(
            (i + 1).cast("long").alias("line_no"),
            F.array_join(F.slice(lines, i + 1, n), "\n").alias("line_text"),
            at.alias("line_at"),
            F.array(inner).alias("ranges"),
            (F.slice(lines, F.greatest(i - b, F.lit(0)) + 1, F.least(i, F.lit(b))) if b else none).alias("before"),
            (F.slice(lines, i + n + 1, F.lit(a)) if a else none).alias("after"),
        )

    hits = F.transform(F.filter(whole, lambda x: F.octet_length(x["part"]["hit"]) > 0), placed)
    return F.transform(hits, made).cast(MATCH)


def matches(files: DataFrame, request: SearchRequest) -> DataFrame:
    """file_id, path, line_no, line_text, ranges, before, after of every matching line, in
    no order. Files that hold a NUL give none."""
    pattern = compiled(request)
    seen = planner.visible(files, request).where(pattern.found(F.col("text")) & ~F.col("text").contains("\x00"))
    ready = seen.select("file_id", "path", "text", split_lines(F.col("text")).alias("lines"))
    starts = running_starts(F.transform("lines", lambda l: (F.octet_length(l) + 1).cast("long")))
    ready = ready.withColumn("line_starts", starts)
    found = ready.select("file_id", "path", F.explode(_block_matches(request) if request.multiline else _line_matches(request)).alias("m"))
    whole = F.transform(
        F.col("m.ranges"),
        lambda r: F.struct((F.col("m.line_at") + r["line_start"]).alias("abs_start"), (F.col("m.line_at") + r["line_end"]).alias("abs_end"), r["line_start"].alias("line_start"), r["line_end"].alias("line_end")),
    )
    return found.select("file_id", "path", F.col("m.line_no").alias("line_no"), F.col("m.line_text").alias("line_text"), whole.alias("ranges"), F.col("m.before").alias("before"), F.col("m.after").alias("after"))


def binary_hits(files: DataFrame, request: SearchRequest) -> DataFrame:
    """Files with a NUL whose text holds the pattern, and whether before the NUL: none of
    their lines is given, and a caller may want to look at them in another way."""
    pattern = compiled(request)
    text = F.col("text")
    seen = planner.visible(files, request).where(text.contains("\x00") & pattern.found(text))
    early = F.substring(F.encode(text, "UTF-8"), 1, EARLY).contains(F.lit(b"\0"))
    before = pattern.found(F.substring_index(text, "\x00", 1))
    # a match before a NUL that comes late is why a tool that streams would have shown lines
    return seen.select("file_id", "path", before.alias("before_nul"), F.when(early, "early_binary").when(before, "late_binary").alias("reason"))


def occurrences(found: DataFrame) -> DataFrame:
    """path, abs_start, abs_end of every range: the identity of a result."""
    return found.select("path", F.explode("ranges").alias("r")).select("path", "r.abs_start", "r.abs_end")


def in_order(found: DataFrame) -> DataFrame:
    """By path in UTF-16 code units, line and first byte."""
    return found.orderBy(F.encode("path", "UTF-16BE"), "line_no", F.get("ranges", F.lit(0))["abs_start"])


def totals(found: DataFrame, limit: int | None) -> DataFrame:
    """One row: lines, occurrences and files in all, lines shown, whether some are not."""
    n = F.count("*")
    shown = n if limit is None else F.least(n, F.lit(limit).cast("long"))
    return found.agg(
        n.alias("total_matches"), F.coalesce(F.sum(F.size("ranges")), F.lit(0)).cast("long").alias("total_occurrences"), F.countDistinct("path").alias("n_files"), shown.alias("displayed"), (n > shown).alias("truncated")
    )


@dataclass
class SearchResult:
    plan: planner.Plan
    request: SearchRequest
    found: DataFrame

    @property
    def matches(self) -> DataFrame:
        """In order, up to the limit."""
        limit = self.request.line_limit
        ordered = in_order(self.found)
        return ordered if limit is None else ordered.limit(limit)

    @property
    def totals(self) -> DataFrame:
        return totals(self.found, self.request.line_limit)


class StaleIndex(RuntimeError):
    pass


def search(request: SearchRequest, index: Index | None = None, files: DataFrame | None = None, distrust: str | None = None) -> SearchResult:
    """By the index if one is given and can serve the request, else by a scan of `files`
    or the index's own. distrust: why the index may not have all changes; then, or if the index
    was invalidated, `files` are scanned."""
    plan = planner.plan(request, index)
    if plan.route == "invalid":
        raise regexes.InvalidRegex(plan.reason)
    reason = distrust or (index.invalid if index is not None else None)
    if reason and index is not None:
        if files is None:
            raise StaleIndex(reason)
        return SearchResult(planner.Plan("scan", reason), request, matches(files, request))
    source = planner.narrowed(plan, request, index) if index is not None else files
    return SearchResult(plan, request, matches(source, request))
