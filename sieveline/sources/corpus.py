"""Files and lines as DataFrames.

files: file_id, path, text, and what decides how a file may be searched. lines: one row
for each line with its number and the byte offset of its start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import running_starts

EARLY = 64 * 1024  # bytes in which a NUL makes a file binary from the start
FLAGS = ("n_bytes", "first_nul", "is_binary", "is_early_binary", "has_bare_cr", "has_kelvin", "has_long_s", "hidden", "ignored")


def split_lines(text: Column) -> Column:
    """Lines without their feeds; a last feed opens no line, and an empty text has none."""
    parts = F.split(text, "\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def with_flags(files: DataFrame) -> DataFrame:
    """files(file_id, path, text) with the columns of FLAGS; `ignored` stays if given."""
    t = F.col("text")
    nul = F.instr(t, F.lit("\x00"))
    return files.withColumns(
        {
            "n_bytes": F.octet_length(t).cast("long"),
            "first_nul": F.when(nul > 0, F.octet_length(F.substring(t, F.lit(1), nul - 1)).cast("long")),
            "is_binary": nul > 0,
            "is_early_binary": F.substring(F.encode(t, "UTF-8"), 1, EARLY).contains(F.lit(b"\0")),
            "has_bare_cr": t.rlike("\r(?!\n)"),
            "has_kelvin": t.contains("\u212a"),
            "has_long_s": t.contains("\u017f"),
            "hidden": F.col("path").rlike(r"(^|/)\."),
            "ignored": F.col("ignored") if "ignored" in files.columns else F.lit(False),
        }
    )


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as a tree: <lang>/<source>/doc-<id>.txt."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    number = F.when(F.length(F.col("doc_id").cast("string")) > 6, F.col("doc_id").cast("string")).otherwise(F.lpad(F.col("doc_id").cast("string"), 6, "0"))
    return docs.select(F.col("doc_id").alias("file_id"), F.concat("lang", F.lit("/"), "source", F.lit("/doc-"), number, F.lit(".txt")).alias("path"), "text")


def decoded(content: Column) -> Column:
    """Bytes as text: by their byte order mark, which is dropped, else as UTF-8 with bad
    sequences replaced."""
    return (
        F.when(F.substring(content, 1, 3) == F.lit(b"\xef\xbb\xbf"), F.make_valid_utf8(F.substring(content, 4, 2**31 - 1).cast("string")))
        .when(F.substring(content, 1, 2).isin(F.lit(b"\xff\xfe"), F.lit(b"\xfe\xff")), F.decode(content, "UTF-16"))
        .otherwise(F.make_valid_utf8(content.cast("string")))
    )


def folder_files(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """The files below a folder, with their paths relative to it, times and lengths; ids
    are hashes of the paths."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    found = (reader.option("pathGlobFilter", glob) if glob else reader).load(folder)
    root = folder.rstrip("/").removeprefix("file://")
    return found.select(
        F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), f"^\\Q{root}\\E/+", "").alias("path"), "content", F.col("modificationTime").alias("modified"), "length"
    ).select(F.xxhash64("path").alias("file_id"), "path", decoded(F.col("content")).alias("text"), "modified", "length")


def ignore_rules(files: DataFrame, names: tuple[str, ...] = (".gitignore", ".ignore")) -> list[tuple[str, str]]:
    """(folder, rule) of every ignore file of files(path, text), outer folders first: an inner
    one decides after an outer one. Ignore files are few, and small, beside what they are for."""
    found = files.where(F.regexp_extract("path", "[^/]*$", 0).isin(*names)).select("path", "text").collect()
    out = []
    for r in sorted(found, key=lambda r: (r.path.count("/"), r.path.rpartition("/")[0], names.index(r.path.rpartition("/")[2]))):
        lines = (line.rstrip("\r").rstrip(" ") for line in (r.text or "").split("\n"))
        out += [(r.path.rpartition("/")[0], line) for line in lines if line and not line.startswith("#")]
    return out


def mark_ignored(files: DataFrame, rules: list) -> DataFrame:
    """Adds `ignored`: the last rule that takes the path or a folder above it decides; a
    rule that begins with `!` takes back, one that ends with a slash is for folders, and one with
    a slash elsewhere starts where it stands. A rule is a string, or (folder, rule) where it holds
    below a folder only. Rules are few and known to the driver."""
    from ..functions.globs import to_regex

    out = F.lit(False)
    for item in rules:
        folder, rule = ("", item) if isinstance(item, str) else item
        back, glob = rule.startswith("!"), rule.removeprefix("!")
        tail = "/.*$" if glob.endswith("/") else "(?:/.*)?$"
        glob = glob.rstrip("/")
        pattern = to_regex(glob)[1:-1]
        prefix = "^" + "".join(c if c.isalnum() or c in "/_" else "\\" + c for c in folder + "/" if folder)
        out = F.when(F.col("path").rlike(f"{prefix}(?:{pattern}){tail}"), F.lit(not back)).otherwise(out)
    return files.withColumn("ignored", out)


def lines(files: DataFrame) -> DataFrame:
    """file_id, path, line_no (from 1), line_start (bytes), line. The starts are summed up
    within the file's row, so nothing is shuffled."""
    ready = files.select("file_id", "path", split_lines(F.col("text")).alias("lines"))
    starts = running_starts(F.transform("lines", lambda l: (F.octet_length(l) + 1).cast("long")))
    each = ready.select("file_id", "path", F.posexplode(F.arrays_zip("lines", starts.alias("starts"))).alias("at", "x"))
    return each.select("file_id", "path", (F.col("at") + 1).cast("long").alias("line_no"), F.col("x.starts").alias("line_start"), F.col("x.lines").alias("line"))


def stable(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths whose time or length differ between two listings, or that are in one only."""
    key = ["path", "modified", "length"]
    both = before.select(*key, F.lit(1).alias("n")).unionByName(after.select(*key, F.lit(-1).alias("n")))
    return both.groupBy(*key).agg(F.sum("n").alias("n")).where("n <> 0").select("path").distinct()


def escapes(path: Column) -> Column:
    """Whether a path leads out of its root, or is none: such a file is not read."""
    return path.isNull() | (path == "") | path.startswith("/") | path.contains("\0") | path.rlike(r"(^|/)\.\.(/|$)")
