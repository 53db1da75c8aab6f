"""Event traces: pairing, interval unions and their complements, usage, percentiles,
redaction."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .compare import alike

#: The operation that a tool's name stands for; others are `tool`.
OPERATIONS = {"grep": "grep", "fast_grep": "grep", "read": "read", "edit": "edit", "write": "write", "bash": "bash", "find": "find", "ls": "ls"}


def operation(tool: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in OPERATIONS.items() for x in pair))
    return F.coalesce(F.try_element_at(names, tool), F.lit("tool"))


def paired(marks: DataFrame, total: DataFrame | None = None) -> DataFrame:
    """Spans of marks(run_id, tool_call_id, tool, phase, at_ms, is_error): a start and an
    end of one id are one span. problem: `orphan_end`, `duplicate_start`,
    `duplicate_end`, `tool_mismatch` or `ends_before_start`; null if all is well. A start
    without an end is `aborted` at its run's total_ms, where total(run_id, total_ms) is
    given."""
    start, end = F.col("phase") == "start", F.col("phase") == "end"
    when = lambda which, c: F.when(which, F.col(c))
    each = marks.groupBy("run_id", "tool_call_id").agg(
        F.count_if(start).alias("starts"), F.count_if(end).alias("ends"), F.min(when(start, "tool")).alias("tool"), F.min(when(end, "tool")).alias("end_tool"),
        F.min(when(start, "at_ms")).alias("start_ms"), F.max(when(end, "at_ms")).alias("end_ms"), F.max(when(end, "is_error")).alias("failed"),
    )
    if total is not None:
        each = each.join(total, "run_id", "left").withColumn("stop", F.coalesce("end_ms", "total_ms")).drop("total_ms")
    else:
        each = each.withColumn("stop", F.col("end_ms"))
    problem = (
        F.when(F.col("starts") == 0, "orphan_end").when(F.col("starts") > 1, "duplicate_start").when(F.col("ends") > 1, "duplicate_end")
        .when(F.col("end_tool") != F.col("tool"), "tool_mismatch").when(F.col("end_ms") < F.col("start_ms"), "ends_before_start")
    )
    status = F.when(F.col("ends") == 0, "aborted").when(F.col("failed"), "error").otherwise("ok")
    return each.select(
        "run_id", "tool_call_id", "tool", operation(F.col("tool")).alias("op"), "start_ms", F.col("stop").alias("end_ms"), (F.col("stop") - F.col("start_ms")).alias("duration_ms"), status.alias("status"), problem.alias("problem")
    )


def islands(spans: DataFrame, by: str = "run_id") -> DataFrame:
    """The union of each run's spans, as spans that don't touch."""
    order = Window.partitionBy(by).orderBy("start_ms", "end_ms")
    reach = F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = spans.select(by, "start_ms", "end_ms", F.coalesce((F.col("start_ms") > reach).cast("int"), F.lit(1)).alias("opens"))
    numbered = opens.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(by, "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).select(by, "start_ms", "end_ms")


def gaps(spans: DataFrame, total: DataFrame, by: str = "run_id") -> DataFrame:
    """What a run's spans leave of [0, total_ms]: by, start_ms, end_ms, duration_ms. Runs
    without spans are all gap; spans of no length, but for rounding, are left out."""
    within = spans.join(total, by).select(by, "start_ms", F.least("end_ms", "total_ms").alias("end_ms"))
    edges = total.select(by, F.col("total_ms").alias("start_ms"), F.col("total_ms").alias("end_ms"))
    order = Window.partitionBy(by).orderBy("start_ms", "end_ms").rowsBetween(Window.unboundedPreceding, -1)
    each = within.unionByName(edges).withColumn("reach", F.greatest(F.coalesce(F.max("end_ms").over(order), F.lit(0.0)), F.lit(0.0)))
    open_ = (F.col("start_ms") > F.col("reach")) & ~alike(F.col("start_ms"), F.col("reach"))
    return each.where(open_).select(by, F.col("reach").alias("start_ms"), F.col("start_ms").alias("end_ms"), (F.col("start_ms") - F.col("reach")).alias("duration_ms"))


def timeline(spans: DataFrame, total: DataFrame) -> DataFrame:
    """Tool spans, overlaps kept, and the gaps as `thinking`."""
    tools = spans.select("run_id", "op", "start_ms", "end_ms", "duration_ms", "status")
    return tools.unionByName(gaps(spans, total).select("run_id", F.lit("thinking").alias("op"), "start_ms", "end_ms", "duration_ms", F.lit("ok").alias("status")))


def usage(messages: DataFrame, by: str = "run_id") -> DataFrame:
    """Token sums of messages(input, output, cache_read, cache_write, reasoning,
    total_tokens, cost_total). A message without a total counts its parts; `reasoning` and
    `cost_total` stay null where no message has them; negative numbers and non-numbers
    count as 0."""
    good = lambda c: F.when((F.col(c) >= 0) & ~F.isnan(F.col(c).cast("double")), F.col(c)).otherwise(F.lit(0))
    parts = good("input") + good("output") + good("cache_read") + good("cache_write")
    own = F.when(good("total_tokens") != 0, good("total_tokens")).otherwise(parts)
    optional = lambda c: F.sum(F.when(F.col(c).isNotNull(), good(c)))
    return messages.groupBy(by).agg(
        *(F.sum(good(c)).alias(c) for c in ("input", "output", "cache_read", "cache_write")), F.sum(own).alias("total_tokens"), optional("reasoning").alias("reasoning"), optional("cost_total").alias("cost_total")
    )


def latency(rows: DataFrame, by: str, value: str) -> DataFrame:
    """count, min, max, mean, p50 and p95 (linear interpolation) by group. Equal values are
    counted before they are sorted, and the sorted counts are summed up as they pass, so that a
    group needs no memory of its own."""
    own = rows.select(F.col(by).alias("g"), F.col(value).alias("v"))
    counts = own.where("v IS NOT NULL").groupBy("g", "v").agg(F.count("*").alias("c"))
    # the frame doesn't look ahead, so the window streams
    to = F.sum("c").over(Window.partitionBy("g").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    totals = own.groupBy("g").agg(F.count("v").alias("n"), F.min("v").alias("min_ms"), F.max("v").alias("max_ms"), F.round(F.avg("v"), 6).alias("mean_ms"))
    sizes = totals.select(F.col("g").alias("of"), "n")
    placed = counts.withColumn("to", to).join(sizes, F.col("g").eqNullSafe(F.col("of"))).drop("of")

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("to") - F.col("c") <= rank) & (rank < F.col("to")), F.col("v")))

    parts = []
    for name, q in (("p50", 0.5), ("p95", 0.95)):
        rank = (F.col("n") - 1) * q
        parts += [at(F.floor(rank)).alias(f"{name}_low"), at(F.ceil(rank)).alias(f"{name}_high"), F.max(rank - F.floor(rank)).alias(f"{name}_part")]
    found = placed.groupBy(F.col("g").alias("of")).agg(*parts)
    line = lambda p: F.round(F.col(f"{p}_low") + (F.col(f"{p}_high") - F.col(f"{p}_low")) * F.col(f"{p}_part"), 6).alias(f"{p}_ms")
    joined = totals.join(found, F.col("g").eqNullSafe(F.col("of")), "left")
    return joined.select(F.col("g").alias(by), "n", "min_ms", "max_ms", "mean_ms", line("p50"), line("p95"))


def signature(arguments: Column) -> Column:
    """What may be kept of a map of arguments: its sorted keys, and hashes."""
    keys = F.array_sort(F.map_keys(arguments))
    of = lambda k: F.sha2(F.encode(F.try_element_at(arguments, F.lit(k)), "UTF-8"), 256)
    canonical = F.array_join(F.transform(keys, lambda k: F.concat(k, F.lit("="), F.coalesce(F.try_element_at(arguments, k), F.lit("null")))), "\0")
    return F.struct(
        F.lit(1).alias("schema_version"), keys.alias("argument_keys"), F.sha2(F.encode(canonical, "UTF-8"), 256).alias("digest"), of("pattern").alias("pattern_hash"), of("path").alias("path_hash"), of("glob").alias("glob_hash")
    )


def repository_path(path: Column, root: str) -> Column:
    """A path in a way that tells nothing of where the repository lies."""
    root = root.rstrip("/")
    inside = F.concat(F.lit("<repo>/"), path.substr(F.lit(len(root) + 2), F.length(path)))
    return (
        F.when(path == root, "<repo>").when(path.startswith(root + "/"), inside).when(path.startswith("/"), F.concat(F.lit("<external:"), F.sha2(F.encode(path, "UTF-8"), 256), F.lit(">"))).otherwise(F.concat(F.lit("<repo>/"), path))
    )


TRACE_SCHEMA = (
    "run_id string, workflow_id string, comparison_id string, attempt int, repo string, repo_sha string, backend_requested string, model string, thinking string, prompt_hash string, started_at string, "
    "total_ms double, status string, token_usage struct<input:double,output:double,cache_read:double,cache_write:double,reasoning:double,total_tokens:double,cost_total:double>, "
    "events array<struct<op:string,tool:string,tool_call_id:string,start_ms:double,end_ms:double,duration_ms:double,status:string,actual_backend:string,fallback_reason:string,result_count:bigint,truncated:boolean>>"
)


def read_runs(spark, path: str) -> DataFrame:
    """Runs from JSON, of a fixed schema; `invalid` says what is wrong with one."""
    runs = spark.read.schema(TRACE_SCHEMA).json(path)
    bad = (
        F.when(F.col("run_id").isNull() | (F.col("run_id") == ""), "run_id").when(~F.col("attempt").between(1, 2**31 - 1) | F.col("attempt").isNull(), "attempt")
        .when(~F.coalesce(F.col("prompt_hash").rlike("^[a-f0-9]{64}$"), F.lit(False)), "prompt_hash").when(~F.coalesce(F.col("total_ms") >= 0, F.lit(False)), "total_ms")
        .when(F.col("started_at").isNotNull() & F.try_to_timestamp("started_at").isNull(), "started_at")
        .when(F.exists(F.col("events"), lambda e: F.coalesce(e["end_ms"] < e["start_ms"], F.lit(True))), "events")
    )
    return runs.withColumn("invalid", bad).withColumn("started_at", F.try_to_timestamp("started_at"))


def trace_events(runs: DataFrame) -> DataFrame:
    return runs.select("run_id", F.explode("events").alias("e")).select("run_id", "e.*")


def write_runs(runs: DataFrame, path: str) -> None:
    """Runs as JSON, all or none: an invalid one stops the writing, and the folder has its name
    only when all is written."""
    spark = runs.sparkSession
    beside = f"{path}.{uuid.uuid4().hex}"
    runs.select(_fields(TRACE_SCHEMA)).withColumn("started_at", F.col("started_at").cast("string")).write.option("ignoreNullFields", "false").json(beside)
    bad = read_runs(spark, beside).where("invalid IS NOT NULL").select("run_id", "invalid").first()
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(beside)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if bad is not None or not fs.rename(at, jvm.org.apache.hadoop.fs.Path(path)):
        fs.delete(at, True)
        raise ValueError(f"run {bad.run_id}: {bad.invalid}" if bad is not None else f"{path} is there already")


def _fields(schema: str) -> list[str]:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).names
