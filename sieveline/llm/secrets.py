"""Secret scans, in DataFrame functions only.

Three base kinds are regular expressions; a fourth, `entropy`, is the method of this
module: over every candidate string (a run of 20 or more token characters that holds a
digit) a window of 20 characters slides, its character counts and the sum of c*log2(c)
are kept up by the one character that enters and the one that leaves, and the string is
reported when the largest Shannon entropy of a window reaches the bound of the string's
character class. Strings that an allow-list pattern matches are left out.

Cases: a null text is an empty one and has no span; rows are taken one by one, so
repeated rows, ties and null ids change nothing; an empty table gives an empty one; `redact`
carries other columns along whatever their names, `report` leaves them out, and `scan` replaces
one that has the name of its result. Texts are scanned whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import running_reach, running_starts
from .common import free_name, own_columns

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
TOKEN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "entropy")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: UUIDs; digits and signs alone (dates, telephone numbers); paths of plain words, whose
#: loop is possessive, as the JVM takes a stack frame for each round of another.
ALLOWED = (
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"[0-9+/_=-]+",
    r"/?([a-z]+[0-9]{0,4}[/_=-]){2,}+[a-z]*[0-9]{0,4}",
)
#: Least entropy in bits of a window of WINDOW characters, by class: what all but one in 100
#: random strings of 20 characters of the class reach (by simulation), and more of longer ones.
BOUNDS = {"hex": 2.8, "lower": 3.4, "mixed": 3.6}
WINDOW = 20


def _spans(text: Column, pattern: str, kind: int, keep=None, group: int = 0) -> Column:
    """Spans of the leftmost non-overlapping matches: what lies between them and the
    matches themselves alternate, so the running sum of their lengths gives positions.
    keep: of a match's group, whether it counts."""
    p = F.lit(pattern)
    hits = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("hit"), F.regexp_extract_all(text, p, F.lit(group)).alias("part")
    )

    size = lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))
    starts = running_starts(F.transform(hits, lambda x: size(x).cast("long")))

    def placed(x, at):
        good = x["hit"].isNotNull() & (F.lit(True) if keep is None else keep(x["part"]))
        return F.struct((at + F.length(x["gap"])).cast("int").alias("start"), F.lit(kind).alias("kind"), (at + size(x)).cast("int").alias("end"), good.alias("good"))

    found = F.filter(F.zip_with(hits, starts, placed), lambda x: x["good"])
    spans = F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))


def _plogp(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))


def peak_entropy(s: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits, of a window of s; s over ALPHABET."""
    codes = F.transform(F.split(s, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    late = F.concat(F.array_repeat(F.lit(0), window), codes)
    both = F.filter(F.zip_with(codes, late, lambda c, old: F.struct(c.alias("new"), old.alias("old"))), lambda x: x["new"].isNotNull())
    pairs = F.transform(both, lambda x, i: F.struct(x["new"].alias("new"), x["old"].alias("old"), i.alias("i")))
    start = F.struct(F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("counts"), F.lit(0.0).alias("sum"), F.lit(-1.0).alias("best"))

    def step(acc, x):
        left = F.get(acc["counts"], x["old"])
        less = F.when(x["old"] > 0, _plogp(left - 1) - _plogp(left)).otherwise(F.lit(0.0))
        had = F.get(acc["counts"], x["new"]) - F.when(x["old"] == x["new"], 1).otherwise(0)
        total = acc["sum"] + less + _plogp(had + 1) - _plogp(had)
        counts = F.transform(acc["counts"], lambda v, k: v + F.when(k == x["new"], 1).otherwise(0) - F.when((k == x["old"]) & (k > 0), 1).otherwise(0))
        entropy = F.log2(F.lit(float(window))) - total / window
        return F.struct(counts.alias("counts"), total.alias("sum"), F.when(x["i"] >= window - 1, F.greatest(acc["best"], entropy)).otherwise(acc["best"]).alias("best"))

    return F.aggregate(pairs, start, step, lambda acc: acc["best"])


def _surprising(s: Column, allowed, bounds, window: int) -> Column:
    quiet = F.lit(False)
    for p in allowed:
        quiet = quiet | s.rlike(f"^(?:{p})$")
    bound = F.when(s.rlike("^[0-9a-f]+$"), bounds["hex"]).when(s.rlike("^[0-9a-z+/_=-]+$"), bounds["lower"]).otherwise(bounds["mixed"])
    return ~quiet & (peak_entropy(s, window) >= bound)


def scan(docs: DataFrame, text: str = "text", allowed=ALLOWED, bounds=BOUNDS, window: int = WINDOW, into: str = "found") -> DataFrame:
    """docs with `into`, the spans of every kind as array<struct<start, kind, end>> in
    code points, by start and then kind; kind is an index of KINDS."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    kinds = [
        _spans(t, ASSIGN, 0, lambda v: F.length(v) >= 12, 1),
        _spans(t, ACCESS, 1, lambda v: F.length(v) >= 18),
        _spans(t, HEX, 2),
        _spans(t, TOKEN, 3, lambda v: _surprising(v, allowed, bounds, window)),
    ]
    return docs.withColumn(into, F.array_sort(F.concat(*kinds)))


def spelled(found: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: counts of base spans, their digest, all spans."""
    found = F.col("found")
    count = lambda k: F.size(F.filter(found, lambda x: x["kind"] == k)).cast("long")
    return scan(docs.select("doc_id", "text")).select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(F.encode(spelled(F.filter(found, lambda x: x["kind"] < 3)), "UTF-8"), 256).alias("base_sha256"),
        spelled(found).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with each secret of `text` replaced by mark; spans that overlap or touch give one.
    What lies between is gathered in pieces, which are joined once."""
    t, found = F.col("text"), free_name(docs, "found")
    reach = running_reach(F.transform(found, lambda x: x["end"]))
    both = F.zip_with(F.col(found), reach, lambda x, before: F.struct(x["start"].alias("start"), before.alias("before")))
    apart = F.filter(both, lambda x: x["start"] > x["before"])
    pieces = F.transform(apart, lambda x: t.substr(F.greatest(x["before"], F.lit(0)) + 1, x["start"] - F.greatest(x["before"], F.lit(0))))
    last = F.array_max(F.transform(found, lambda x: x["end"]))
    clean = F.concat(F.array_join(pieces, mark), F.lit(mark), t.substr(last + 1, F.length(t) - last))
    columns = [F.when(F.size(found) > 0, clean).otherwise(t).alias("text") if c == "text" else own for c, own in zip(docs.columns, own_columns(docs), strict=True)]
    return scan(docs, into=found).select(columns)
