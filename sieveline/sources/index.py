"""The trigram index: postings and document frequencies, in generations.

A generation is a folder of Parquet tables. Files are dealt out to parts by
ranges of their ids and lie there in the order of ids, in small pages, so that a search that names its files reads
little else: parts by their folders, pages by their least and greatest ids. `paths` has the same
without texts. A posting list is the ids of one gram in one part, or in a stretch of a part that has
very many, rising, which Parquet keeps as differences; lists are sorted by gram, so that a lookup of
a few grams reads a few pages.

A generation's number is claimed by a file that only one writer can create, and its manifest,
named by the number, appears in one step when all is written. The one in use is the greatest
that has a manifest, so a reader always finds a whole one, and writers can't meet.
"""

from __future__ import annotations

import itertools
import json
import re
import time
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

GRAM = "(?=([A-Za-z0-9_]{3}))"


def postings(files: DataFrame) -> DataFrame:
    """gram, file_id: the distinct trigrams of word characters of each file."""
    return files.select("file_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(GRAM), F.lit(1)))).alias("gram")).select("gram", "file_id")


def frequencies(posted: DataFrame) -> DataFrame:
    """gram, gram_key (its bytes as a number), folded, df."""
    key = F.conv(F.hex(F.encode("gram", "UTF-8")), 16, 10).cast("int")
    return posted.groupBy("gram").agg(F.count("*").alias("df")).select("gram", key.alias("gram_key"), F.lower("gram").alias("folded"), "df")


def digest(files: DataFrame) -> DataFrame:
    """One row: files, bytes, and a digest of all paths and contents that doesn't depend
    on their order: the sum of each file's framed hash."""
    framed = F.concat_ws("|", F.octet_length("path").cast("string"), "path", F.octet_length("text").cast("string"), F.sha2(F.encode("text", "UTF-8"), 256))
    number = F.conv(F.substring(F.sha2(F.encode(framed, "UTF-8"), 256), 1, 13), 16, 10).cast("long")
    # the sum of many numbers of 52 bits is no long
    total = (F.sum(number.cast("decimal(20,0)")) % F.lit(10**18).cast("decimal(20,0)")).cast("long")
    return files.select(F.count("*").alias("n_files"), F.sum(F.octet_length("text")).cast("long").alias("n_bytes"), total.alias("digest"))


#: The list of files with a letter that only folding makes ASCII: Kelvin sign, long s.
FOLDED_LETTERS = "\u212a\u017f"
PART_BYTES, PAGE_ROWS = 32 << 20, 32
MOST_PARTS = 50_000
#: Of so many ids at most, 8 MB, a list may be held by the driver.
HELD_IDS = 1_000_000


#: Bytes of text looked at at once, and postings that a task holds before it gives their lists.
STEP_BYTES, HELD_POSTINGS = 4 << 20, 4 << 20
SIGNS = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"
N_GRAMS = len(SIGNS) ** 3


def posting_lists(files: DataFrame) -> DataFrame:
    """gram, part, ids of files(file_id, part, text): rising ids of those that have the gram. Files
    of a part that lie together give one list a gram, unless they have over HELD_POSTINGS. A task
    makes its lists itself, so that no row is made, sorted or shuffled for a single posting."""
    kind = files.schema["file_id"].dataType.simpleString()
    return files.select("file_id", "part", "text").mapInArrow(_listed, f"gram string, part {files.schema['part'].dataType.simpleString()}, ids array<{kind}>")


def _listed(batches):
    held, part, n = [], None, 0
    for batch in batches:
        ids, parts, texts = (batch.column(c) for c in ("file_id", "part", "text"))
        texts = texts.fill_null("").cast(pa.large_string())
        for start, stop in _strides(parts, _offsets(texts)):
            if held and parts[start] != part:
                yield _lists_of(held, part)
                held, n = [], 0
            part, own = parts[start], ids[start:stop]
            for rows, grams in _grams_of(texts[start:stop]):
                held.append((own, rows, grams))
                n += len(rows)
            # between files only, so that none is in two lists of a gram
            if n > HELD_POSTINGS:
                yield _lists_of(held, part)
                held, n = [], 0
    if held:
        yield _lists_of(held, part)


def _offsets(texts: pa.Array) -> np.ndarray:
    return np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)


def _strides(parts: pa.Array, at: np.ndarray):
    """Stretches of rows that are of one part and of STEP_BYTES, or of one row."""
    start, n = 0, len(parts)
    ends = np.append(np.flatnonzero(np.asarray(pc.not_equal(parts[1:], parts[:-1]), bool)) + 1, n)
    while start < n:
        stop = max(start + 1, int(np.searchsorted(at, at[start] + STEP_BYTES, "right")) - 1)
        stop = min(stop, int(ends[np.searchsorted(ends, start, "right")]))
        yield start, stop
        start = stop


def _grams_of(texts: pa.Array):
    """Rows and gram numbers of texts, each pair once in a step. Bytes beyond ASCII are no word
    characters, so a text's bytes have the same grams as its characters. N_GRAMS marks a text with
    one of FOLDED_LETTERS."""
    at = _offsets(texts)
    if at[-1] - at[0] < 2:
        return
    odd = np.flatnonzero(np.asarray(pc.match_substring_regex(texts, f"[{FOLDED_LETTERS}]"), bool))
    if len(odd):
        yield odd, np.full(len(odd), N_GRAMS, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)
    for begin in range(int(at[0]), int(at[-1]) - 2, STEP_BYTES):
        end = min(begin + STEP_BYTES, int(at[-1]) - 2)
        sign = _SIGN_AT[data[begin : end + 2]]
        first, last = np.searchsorted(at, [begin, end - 1], "right") - 1
        ends = at[first + 1 : last + 2]
        word = sign < len(SIGNS)
        whole = word[:-2] & word[1:-1] & word[2:]
        for back in (1, 2):  # what reaches into the next text is no gram
            cut = ends - back - begin
            whole[cut[(cut >= 0) & (cut < len(whole))]] = False
        where = np.flatnonzero(whole)
        sign = sign.astype(np.uint32)
        gram = ((sign[:-2] * len(SIGNS) + sign[1:-1]) * len(SIGNS) + sign[2:])[where]
        row = np.searchsorted(ends, where + begin, "right")
        kind = np.uint32 if last - first < 1 << 14 else np.uint64
        key = _distinct(row.astype(kind) << kind(18) | gram)
        yield (key >> kind(18)).astype(np.int64) + first, (key & kind((1 << 18) - 1)).astype(np.int64)


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys.sort()
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


_SIGN_AT = np.full(256, len(SIGNS), np.uint8)
_SIGN_AT[list(SIGNS)] = np.arange(len(SIGNS))


def _lists_of(held: list, part: pa.Scalar) -> pa.RecordBatch:
    """The lists of what a task holds of one part."""
    before = np.cumsum([0] + [0 if i and own is held[i - 1][0] else len(own) for i, (own, _, _) in enumerate(held)])
    ids = pa.concat_arrays([own for i, (own, _, _) in enumerate(held) if not i or own is not held[i - 1][0]])
    rising = pc.sort_indices(ids)
    rank = np.zeros(len(ids), np.int64)
    rank[np.asarray(rising)] = np.arange(len(ids))
    # several steps of one text may have the same gram
    key = _distinct(np.concatenate([gram << 32 | rank[rows + (end - len(own))] for (own, rows, gram), end in zip(held, before[1:], strict=True)]))
    gram, of = key >> 32, ids.take(rising).take(pa.array(key & (1 << 32) - 1))
    if of.null_count:
        known = np.asarray(of.is_valid(), bool)
        gram, of = gram[known], of.filter(pa.array(known))
    begin = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])) if len(gram) else np.zeros(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(gram)), pa.int32()), of)
    names = pa.array([_name(g) for g in gram[begin].tolist()], pa.string())
    return pa.RecordBatch.from_arrays([names, pa.array([part.as_py()] * len(names), part.type), lists], ["gram", "part", "ids"])


def _name(gram: int) -> str:
    if gram == N_GRAMS:
        return FOLDED_LETTERS
    return bytes((SIGNS[gram // len(SIGNS) ** 2], SIGNS[gram // len(SIGNS) % len(SIGNS)], SIGNS[gram % len(SIGNS)])).decode()


def list_frequencies(lists: DataFrame) -> DataFrame:
    """What frequencies() gives, of posting lists."""
    key = F.conv(F.hex(F.encode("gram", "UTF-8")), 16, 10).cast("int")
    df = lists.where(F.col("gram") != FOLDED_LETTERS).groupBy("gram").agg(F.sum(F.size("ids")).alias("df"))
    return df.select("gram", key.alias("gram_key"), F.lower("gram").alias("folded"), "df")


@dataclass
class Index:
    """Tables of one generation. `files` are the files it was built of, with their parts."""

    files: DataFrame
    paths: DataFrame
    lists: DataFrame
    grams: DataFrame
    generation: int = 0
    n_files: int | None = None
    slots: int = 1
    invalid: str | None = None  # why it may not be used
    parts: tuple = ((0, -(2**63)),)  # part and least id, by id
    _held: dict = field(default_factory=dict, repr=False)

    @classmethod
    def in_memory(cls, files: DataFrame) -> Index:
        own = files.withColumn("part", F.lit(0))
        lists = posting_lists(own)
        return cls(own, own.drop("text"), lists, list_frequencies(lists))

    @property
    def postings(self) -> DataFrame:
        """gram, file_id."""
        return self.lists.where(F.col("gram") != FOLDED_LETTERS).select("gram", F.explode("ids").alias("file_id"))

    def parts_at(self, ids: np.ndarray) -> np.ndarray:
        """The parts in which ids would lie."""
        number, least = (np.array(x, np.int64) for x in zip(*self.parts, strict=True))
        return np.unique(number[np.maximum(np.searchsorted(least, ids, "right") - 1, 0)])

    @property
    def size(self) -> int:
        if self.n_files is None:
            self.n_files = self.files.count()
        return self.n_files

    def held(self, key, make):
        """make(), kept for later searches; what was kept first goes first."""
        if key not in self._held:
            while len(self._held) >= 64:
                self._held.pop(next(iter(self._held)))
            self._held[key] = make()
        return self._held[key]

    @property
    def frequencies(self) -> dict[str, int]:
        """df of each gram: of 63 characters there are no more than 250,047."""
        return self.held("frequencies", lambda: {r.gram: r.df for r in self.grams.select("gram", "df").collect()})

    def parts_of(self, grams: list[str]) -> DataFrame:
        """gram, part, ids of these grams."""
        rows = self.lists.where(F.col("gram").isin(*grams))
        if "slot" in self.lists.columns:
            rows = rows.where(F.col("slot").isin(*sorted({slot_of(g, self.slots) for g in grams})))
        return rows

    def ids_of(self, grams: list[str]) -> dict[str, np.ndarray]:
        """The rising ids of grams whose lists, by their known frequencies, may be held."""
        new = [g for g in grams if ("ids", g) not in self._held]
        if new:
            got = self.parts_of(new).select("gram", "ids").toArrow()
            names, lists = np.array(got.column("gram").to_pylist(), object), got.column("ids").combine_chunks()
            for g in new:
                self.held(("ids", g), lambda g=g: np.unique(np.asarray(lists.take(pa.array(np.flatnonzero(names == g))).flatten(), np.int64)))
        return {g: self.held(("ids", g), lambda: np.zeros(0, np.int64)) for g in grams}


def slot_of(gram: str, slots: int) -> int:
    return int.from_bytes(gram.encode()[:3], "big") % slots


def file_system(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file beside its name and renames it there. The name is to be new, so that
    a reader finds a whole file or none."""
    fs, new = file_system(spark, path + f".{time.time_ns()}")
    out = fs.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    _, at = file_system(spark, path)
    fs.rename(new, at)


def get_text(spark: SparkSession, path: str) -> str | None:
    fs, at = file_system(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return text


def names(spark: SparkSession, folder: str, pattern: str) -> list[tuple[int, str]]:
    """Numbers and names of what lies in a folder under such a name, rising."""
    fs, at = file_system(spark, folder)
    if not fs.exists(at):
        return []
    names = (status.getPath().getName() for status in fs.listStatus(at))
    return sorted((int(m[1]), n) for n in names if (m := re.fullmatch(pattern, n)))


def _claimed(spark: SparkSession, folder: str) -> int:
    """A generation number that no other writer has."""
    fs, at = file_system(spark, folder)
    fs.mkdirs(at)
    taken = [n for n, _ in names(spark, folder, r"(?:gen=|claim-|manifest-)(\d+)(?:\.json)?")]
    n = max(taken, default=0)
    while True:
        n += 1
        try:
            fs.create(file_system(spark, f"{folder}/claim-{n}")[1], False).close()
            return n
        except Py4JJavaError as why:
            if not fs.exists(file_system(spark, f"{folder}/claim-{n}")[1]):
                raise why


def _bytes_of(files: DataFrame) -> int:
    """About how large files are: what the optimizer thinks, or, where it knows nothing, a sum."""
    guess = int(str(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return guess if guess < 1 << 60 else files.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def manifest(spark: SparkSession, folder: str) -> dict | None:
    """That of the generation in use."""
    found = names(spark, folder, r"manifest-(\d+)\.json")
    return json.loads(get_text(spark, f"{folder}/{found[-1][1]}")) if found else None


def write(files: DataFrame, folder: str, snapshot: str = "", codec: str = "zstd", part_bytes: int = PART_BYTES) -> Index:
    """Builds a new generation and then makes it the one in use. `snapshot` names the state of
    the source that the files are of."""
    spark = files.sparkSession
    generation = _claimed(spark, folder)
    at = f"{folder}/gen={generation}"
    size = _bytes_of(files)
    # enough parts for every core, unless they would be tiny
    parts = max(1, min(MOST_PARTS, -(-size // part_bytes)), min(spark.sparkContext.defaultParallelism, size >> 18))
    slots = max(1, min(256, parts // 4))
    dealt = files.repartitionByRange(parts, "file_id").withColumn("part", F.spark_partition_id())
    whole = dealt.sortWithinPartitions("part", "file_id").write.mode("overwrite").option("compression", codec).partitionBy("part")
    whole.option("parquet.page.row.count.limit", PAGE_ROWS).option("parquet.page.size.row.check.min", PAGE_ROWS).parquet(f"{at}/files")
    kept = spark.read.schema(dealt.schema).parquet(f"{at}/files")
    kept.drop("text").sortWithinPartitions("path").write.mode("overwrite").option("compression", codec).parquet(f"{at}/paths")
    slot = F.pmod(F.conv(F.hex(F.substring(F.encode("gram", "UTF-8"), 1, 3)), 16, 10).cast("long"), F.lit(slots)).cast("int")
    lists = posting_lists(kept).withColumn("slot", slot).repartition("slot", "gram").sortWithinPartitions("slot", "gram", "part")
    lists.write.mode("overwrite").option("compression", codec).option("parquet.writer.version", "PARQUET_2_0").partitionBy("slot").parquet(f"{at}/lists")
    found = spark.read.schema(lists.schema).parquet(f"{at}/lists")
    list_frequencies(found).coalesce(1).sortWithinPartitions("gram").write.mode("overwrite").option("compression", codec).parquet(f"{at}/grams")
    n, size, total = digest(kept).first()
    least = sorted((r.least, r.part) for r in spark.read.parquet(f"{at}/paths").groupBy("part").agg(F.min("file_id").alias("least")).collect())
    put_text(
        spark, f"{folder}/manifest-{generation}.json",
        json.dumps({"generation": generation, "snapshot": snapshot, "n_files": n, "n_bytes": size, "digest": total, "slots": slots, "parts": [(part, i) for i, part in least], "schema": dealt.schema.jsonValue(), "built_at": time.time()}),
    )
    return open_index(spark, folder)


def open_index(spark: SparkSession, folder: str, check: bool = False) -> Index:
    """The generation in use; check: whether its files still have the manifest's digest."""
    own = manifest(spark, folder)
    if own is None:
        raise FileNotFoundError(folder)
    at = f"{folder}/gen={own['generation']}"
    schema = StructType.fromJson(own["schema"])
    files = spark.read.schema(schema).parquet(f"{at}/files")
    lists = spark.read.schema(f"gram string, part int, ids array<{schema['file_id'].dataType.simpleString()}>, slot int").parquet(f"{at}/lists")
    index = Index(files, spark.read.parquet(f"{at}/paths"), lists, spark.read.parquet(f"{at}/grams"), own["generation"], own["n_files"], slots=own["slots"], parts=tuple(map(tuple, own["parts"])) or Index.parts)
    index.invalid = get_text(spark, f"{folder}/invalid-{index.generation}")
    if check and tuple(digest(index.files).first()) != (own["n_files"], own["n_bytes"], own["digest"]):
        raise ValueError("the index does not have the contents that its manifest names")
    return index


def invalidate(spark: SparkSession, folder: str, reason: str) -> bool:
    """Latches the generation in use: from now on searches by it take the scan and give the
    reason. It can't be taken back; the next generation starts anew. Whether this call did it."""
    own = manifest(spark, folder)
    fs, at = file_system(spark, f"{folder}/invalid-{own['generation']}")
    try:
        out = fs.create(at, False)
    except Py4JJavaError:
        return False
    out.write(bytearray(reason.encode()))
    out.close()
    return True


def vacuum(spark: SparkSession, folder: str, keep: int = 1) -> list[str]:
    """Deletes generations before the `keep` last ones, with their manifests; says which. What
    lies there without a manifest and is younger than the one in use may be at work and stays."""
    now = manifest(spark, folder)["generation"]
    fs, _ = file_system(spark, folder)
    old = [(n, name) for n, name in names(spark, folder, r"(?:manifest-|claim-|gen=|invalid-)(\d+)(?:\.json)?") if n <= now - keep]
    # a manifest goes before what it names
    for _, name in sorted(old, key=lambda x: (not x[1].startswith("manifest"), x)):
        fs.delete(file_system(spark, f"{folder}/{name}")[1], True)
    return sorted(name for _, name in old if name.startswith("gen="))
