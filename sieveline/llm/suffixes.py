"""Removal of repeated byte strings, by range-partitioned sorting of sampled suffixes.

A string of WIDTH bytes that starts at two places is found through an anchor: of its
GRAM-byte grams the one with the least hash, the last of equals. The anchor depends on the
string alone, so equal strings have theirs at the same offset, and the windows of a text
fall to its anchors in runs. About one position in 76 is an anchor, and only suffixes that
begin at anchors are sorted.

1. Texts are made distinct (copies are known to repeat as a whole). Anchors whose gram's hash
   is met once in all texts are done: their windows are unique. A context is what an anchor's
   windows cover. Within a task, equal contexts, compared byte by byte, repeat, and one stands
   for all from here on.
2. Contexts are dealt out by range: splitters from a sample of leading tokens (48 bytes) bound
   the buckets, in order. What equals a splitter stands at a boundary and would fall on both
   sides of it; it has a bucket of its own, in which it is compared across. So suffixes that
   share a gram, whose first 48 bytes are leading tokens, always meet.
3. A range is sorted by leading tokens and cut, where they change, into stretches of bounded
   size. A stretch is sorted by three-way multikey quicksort, 8 bytes a key, and neighbours
   give the longest common prefixes; what precedes the anchors is sorted in the same way within
   equal grams. A window, o bytes before its anchor and WIDTH - o after, repeats when another
   row is in its class of both.
4. A gram met in more than HOT contexts, or in so many of a sample (COMMON at least) that it
   must be in more than HOT of all, is more than one task may hold, and no boundary can be put
   within it, as what precedes the anchor matters as well. The windows of such anchors are dealt out
   one by one by 128-bit digests, over as many shards as the input needs; in a batch equal ones
   are sent once. This is the one place where a hash decides.
5. Spans go back to the texts by the texts' digest.

Cases: a null text is empty; texts shorter than WIDTH lose nothing; repeated rows repeat
each other and lose all that WIDTH bytes cover; texts of any length are taken whole, in
overlapping parts; null ids are carried along; an empty table gives no rows; other columns
are left out, or carried along by without_repeats, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import buffers, lean, pieces, splitmix

WIDTH, GRAM = 200, 50
SPAN = WIDTH - GRAM + 1
PART = (1 << 20) - WIDTH  # windows looked at at once
HOT = 60_000
BUCKET = 20_000
CHUNK = 2_000  # anchors whose windows are digested at once
SAMPLE, COMMON = 1500, 15  # texts looked at first; in fewer of them no gram is known to be common
_BITS = np.uint64(21)
_LOW = np.uint64((1 << 21) - 1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BYTE = splitmix(np.arange(256, dtype=np.uint64))
LEAD = 48  # bytes of leading tokens; no more than GRAM
SPLITTERS = 20_000
SMALL = 48  # rows that are sorted at once
KNOWN, SEND, FLOOD = 1, 2, 4  # what is to do with an anchor
HEAD, AGAIN, SHARED = 1, 2, 4  # first or later of equal contexts in a batch; of a common gram
_TABLES: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_TABLES.get("up", ())) < n:
        size = max(n, PART + 2 * WIDTH)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", inverse)):
                _TABLES[name] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, base, np.uint64)]), dtype=np.uint64)
    return _TABLES["up"][:n], _TABLES["down"][:n]


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each run of windows with one anchor: row, place of the anchor in the row's
    bytes, the largest and least offset of the anchor in the run's windows, gram hash and
    context hash."""
    parts = []
    for a, b in pieces(offsets, PART):
        begin, stop = int(offsets[a]), int(offsets[b])
        for low in range(begin, max(begin + 1, stop), PART):
            high = min(stop, low + PART + WIDTH - 1)
            n = high - low
            if n < WIDTH:
                continue
            up, down = _powers(n)
            sums = np.zeros(n + 1, np.uint64)
            with np.errstate(over="ignore"):
                np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
                other = np.zeros(n + 1, np.uint64)
                np.cumsum(_BYTE[data[low:high]] * up, out=other[1:])
                gram = splitmix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
            least = (gram & ~_LOW) | (_LOW - np.arange(len(gram), dtype=np.uint64))
            step, width = 1, 1
            while width * 2 <= SPAN:
                least = np.minimum(least[:-step], least[step:])
                width, step = width * 2, step * 2
            if width < SPAN:
                least = np.minimum(least[: len(least) - (SPAN - width)], least[SPAN - width :])
            chosen = (_LOW - (least & _LOW)).astype(np.int64)
            start = np.arange(len(chosen))
            row = np.searchsorted(offsets, start + low, "right") - 1
            good = start + low + WIDTH <= offsets[row + 1]
            good &= start < PART
            start, chosen, row = start[good], chosen[good], row[good]
            if not len(start):
                continue
            new = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1])]))
            last = np.concatenate([new[1:], [len(start)]]) - 1
            at, head = chosen[new], start[new]
            most, least = at - head, at - start[last]
            with np.errstate(over="ignore"):
                context = splitmix((other[at - least + WIDTH] - other[head]) * down[head] + ((most << 8) | least).astype(np.uint64))
            parts.append((row[new], at + low - offsets[row[new]], most, least, gram[at], context))
    if not parts:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _alike(data: np.ndarray, offsets: np.ndarray, found, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether the contexts of two anchors are the same bytes; their offsets are equal."""
    row, at, most, least = found
    out = np.zeros(len(one), bool)
    begin, size = at + offsets[row] - most, most - least + WIDTH
    for i in range(0, len(one), 2048):
        a, b = one[i : i + 2048], other[i : i + 2048]
        same = _gathered(data, begin[a], SPAN + WIDTH) == _gathered(data, begin[b], SPAN + WIDTH)
        out[i : i + 2048] = (same | (np.arange(SPAN + WIDTH) >= size[a][:, None])).all(axis=1)
    return out


def _gathered(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """width bytes from each place on, in rows; beyond the end the last byte again. The places
    of all bytes, eight times as large, are never there at once."""
    out = np.empty((len(at), width), np.uint8)
    for i in range(0, len(at), 2048):
        np.take(data, at[i : i + 2048, None] + np.arange(width), mode="clip", out=out[i : i + 2048])
    return out


def _find_anchors(common: np.ndarray):
    """Anchors of each text. Of equal contexts in a batch one stands for all; the others
    are known and need no comparison, so they take a gram of their own, as do anchors of
    common grams, which are compared in another way."""

    @lean
    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            row, at, most, least, gram, context = anchors(data, offsets)
            place = (at << 16) | (most << 8) | least
            n = len(row)
            order = np.lexsort((np.arange(n), context, most << 8 | least, gram))
            near = np.flatnonzero((gram[order][1:] == gram[order][:-1]) & (context[order][1:] == context[order][:-1]) & ((most - least)[order][1:] == (most - least)[order][:-1]) & (most[order][1:] == most[order][:-1]))
            equal = np.zeros(max(n - 1, 0), bool)
            equal[near] = _alike(data, offsets, (row, at, most, least), order[near], order[near + 1])
            kind = np.zeros(n, np.int32)
            if n:
                kind[order[1:][equal]] = AGAIN
                heads = order[:-1][equal]
                kind[heads[kind[heads] == 0]] = HEAD
                kind[(kind != AGAIN) & np.isin(gram, common)] |= SHARED
            alone = kind >= AGAIN
            with np.errstate(over="ignore"):
                gram = np.where(alone, splitmix(context + np.arange(n, dtype=np.uint64) + place.astype(np.uint64)), gram)
            cut = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
            found = pa.StructArray.from_arrays([pa.array(place), pa.array(gram.view(np.int64)), pa.array(kind)], ["place", "gram", "kind"])
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.ListArray.from_arrays(cut, found)], ["key", "found"])

    return run


@lean
def _sampled(batches):
    """Of sampled texts, leading tokens of some anchors, for the splitters, and the grams
    of each context, for the common ones."""
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        row, at, _, _, gram, context = anchors(data, offsets)
        at = (at + offsets[row])[:: max(1, len(row) // (16 * batch.num_rows) if batch.num_rows else 1)]
        leads = _leads(data, at).tolist()
        order = np.lexsort((context, gram))
        new = np.ones(len(order), bool)
        new[1:] = (context[order][1:] != context[order][:-1]) | (gram[order][1:] != gram[order][:-1])
        grams = gram[order[new]].view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([None] * len(leads) + grams.tolist(), pa.int64()), pa.array(leads + [None] * len(grams), pa.binary())], ["gram", "lead"])


def _leads(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The leading tokens of suffixes, which sort as bytes do."""
    if not len(at):
        return np.zeros(0, f"S{LEAD}")
    out = _gathered(data, at, LEAD)
    out[at[:, None] + np.arange(LEAD) >= len(data)] = 0
    return out.view(f"S{LEAD}").ravel()


def _merged(row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of rows, in order, those that touch as one."""
    order = np.lexsort((begin, row))
    row, begin, end = row[order], begin[order], end[order]
    reach = np.maximum.accumulate(end + (row << 40)) - (row << 40)
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (begin[1:] > reach[:-1])]))
    return row[first], begin[first], reach[np.append(first[1:], len(row)) - 1]


_RECORD = np.dtype([("key", "V16"), ("start", "<i8"), ("a", "<u8"), ("b", "<u8")])


def _contexts(splitters: np.ndarray, shards: int, chunk: int = CHUNK):
    """Known spans of each text, merged; contexts to compare, with the number of the range or
    the boundary that they fall to; and of hot grams, records of all windows, a row for each
    shard, under negative bucket numbers. Windows met twice in the batch are known."""
    schema = pa.schema([("bucket", pa.int32()), ("key", pa.binary()), ("at", pa.int64()), ("most", pa.int32()), ("least", pa.int32()), ("around", pa.binary()), ("start", pa.int64()), ("stop", pa.int64())])

    def rows(n, bucket, **cols):
        whole = {"bucket": bucket} | cols
        return pa.RecordBatch.from_arrays([pa.array(whole[f.name], f.type) if f.name in whole else pa.nulls(n, f.type) for f in schema], schema=schema)

    @lean
    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            raw = data.tobytes()
            todo = batch.column("todo")
            row = np.repeat(np.arange(batch.num_rows), np.asarray(todo.value_lengths(), np.int64))
            flat = todo.flatten()
            place, act = np.asarray(flat.field(0), np.int64), np.asarray(flat.field(1))
            order = np.lexsort((place, row))
            row, place, act = row[order], place[order], act[order]
            at, most, least = place >> 16, (place >> 8) & 255, place & 255
            keys = batch.column("key")

            known = np.flatnonzero(act & KNOWN)
            if len(known):
                r, begin, end = _merged(row[known], (at - most)[known], (at - least)[known] + WIDTH)
                yield rows(len(r), r % 65536, key=keys.take(pa.array(r)), start=begin, stop=end)

            sent = np.flatnonzero(act & SEND)
            for i in range(0, len(sent), 20_000):
                w = sent[i : i + 20_000]
                here = at[w] + offsets[row[w]]
                lead = _leads(data, here)
                bucket = np.searchsorted(splitters, lead, "left") + np.searchsorted(splitters, lead, "right")
                around = [raw[a:b] for a, b in zip((here - most[w]).tolist(), (here - least[w] + WIDTH).tolist(), strict=True)]
                yield rows(len(w), bucket, key=keys.take(pa.array(row[w])), at=at[w], most=most[w], least=least[w], around=around)

            flood = np.flatnonzero(act & FLOOD)
            seen: dict[bytes, tuple[int, int] | None] = {}  # where each was first, until that is known to repeat
            for i in range(0, len(flood), chunk):
                w = flood[i : i + chunk]
                size = most[w] - least[w] + 1
                which = np.repeat(w, size)
                start = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat((at - most)[w], size)
                begin = start + offsets[row[which]]
                digests = [hashlib.blake2b(raw[q : q + WIDTH], digest_size=16).digest() for q in begin.tolist()]
                first = np.ones(len(which), bool)
                met = np.zeros(len(which), bool)  # again in this batch
                place_of: dict[bytes, int] = {}
                before: list[tuple[int, int]] = []  # first places in earlier chunks
                for j, digest in enumerate(digests):
                    if digest in place_of:
                        first[j], met[j], met[place_of[digest]] = False, True, True
                    else:
                        place_of[digest] = j
                        if digest in seen:
                            first[j], met[j] = False, True
                            if seen[digest] is not None:
                                before.append(seen[digest])
                                seen[digest] = None
                if len(seen) > 300_000:
                    seen.clear()  # what is forgotten is sent once more
                for digest, j in place_of.items():
                    if first[j]:
                        seen[digest] = None if met[j] else (int(row[which[j]]), int(start[j]))
                again = np.flatnonzero(met)
                if len(again):
                    r, begin = row[which[again]], start[again]
                    if before:
                        r, begin = (np.concatenate(x) for x in zip((r, begin), np.array(before, np.int64).T, strict=True))
                    r, begin, end = _merged(r, begin, begin + WIDTH)
                    yield rows(len(r), r % 65536, key=keys.take(pa.array(r)), start=begin, stop=end)
                one = np.flatnonzero(first)
                if not len(one):
                    continue
                record = np.empty(len(one), _RECORD)
                record["key"] = np.frombuffer(b"".join(keys[int(r)].as_py() for r in row[which[one]]), "V16")
                record["start"] = start[one]
                two = np.frombuffer(b"".join(digests[j] for j in one.tolist()), np.uint64).reshape(-1, 2)
                record["a"], record["b"] = two[:, 0], two[:, 1]
                shard = (two[:, 0] % np.uint64(shards)).astype(np.int64)
                by = np.argsort(shard, kind="stable")
                cuts = [0, *(np.flatnonzero(np.diff(shard[by])) + 1).tolist(), len(by)]
                blobs = [record[by[a:b]].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield rows(len(blobs), [-1 - int(shard[by[a]]) for a in cuts[:-1]], around=blobs)

    return run


def multikey_sort(words: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """The order of rows by group and then by their words, by three-way multikey quicksort:
    rows are parted into those below, at and above a pivot in one word, and only those at it go
    on to the next word. The pivot is the middle one of up to nine."""
    columns = np.column_stack([groups.astype(np.uint64), words])
    order = np.arange(len(groups))
    todo = [(0, len(order), 0)]
    while todo:
        a, b, word = todo.pop()
        if b - a < 2 or word == columns.shape[1]:
            continue
        rows = order[a:b]
        if b - a <= SMALL:
            order[a:b] = rows[np.lexsort(columns[rows, word:].T[::-1])]
            continue
        key = columns[rows, word]
        nine = np.sort(key[:: -(-len(key) // 9)])
        pivot = nine[len(nine) // 2]
        below, above = key < pivot, key > pivot
        i, j = a + int(below.sum()), b - int(above.sum())
        order[a:b] = np.concatenate([rows[below], rows[~(below | above)], rows[above]])
        todo += [(a, i, word), (i, j, word + 1), (j, b, word)]
    return order


def _common(rows: np.ndarray) -> np.ndarray:
    """How many leading bytes each row has in common with the one before; the first none."""
    out = np.zeros(len(rows), np.int64)
    for i in range(1, len(rows), 16384):
        differ = rows[i : i + 16384] != rows[i - 1 : min(i + 16384, len(rows)) - 1]
        out[i : i + 16384] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def repeated(around: list[bytes], most: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which windows of a bucket's contexts repeat: index, and first and last offset of
    each run of offsets. Exact: bytes are compared, no hashes."""
    n = len(around)
    data = np.frombuffer(b"".join(around), np.uint8)
    lens = np.array([len(x) for x in around])
    begin = np.cumsum(lens) - lens
    head = np.concatenate([np.zeros(SPAN, np.uint8), data, np.zeros(WIDTH + 8, np.uint8)])
    here = begin + most + SPAN
    right = _gathered(head, here, WIDTH)
    right[np.arange(WIDTH) >= (lens - most)[:, None]] = 0
    depth = 8 * (-(-(SPAN - 1) // 8))
    left = np.zeros((n, depth), np.uint8)
    left[:, : SPAN - 1] = _gathered(head, here - (SPAN - 1), SPAN - 1)[:, ::-1]
    left[np.arange(depth) >= most[:, None]] = 0
    by = multikey_sort(np.ascontiguousarray(right).view(">u8").astype(np.uint64), np.zeros(n, np.int64))
    after = _common(right[by])
    group = np.zeros(n, np.int64)
    group[by] = np.cumsum(after < GRAM)
    back = multikey_sort(np.ascontiguousarray(left).view(">u8").astype(np.uint64), group)
    before = _common(left[back])
    g = group[back]
    before[1:][g[1:] != g[:-1]] = -1
    if n:
        before[0] = after[0] = -1
    hit = np.zeros((n, SPAN + 1), bool)
    a, b = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for o in range(SPAN):
        active = np.flatnonzero((least <= o) & (o <= most))
        if len(active) < 2:
            continue
        a[by], b[back] = np.cumsum(after < WIDTH - o), np.cumsum(before < o)
        pair = a[active] * (n + 1) + b[active]
        order = np.argsort(pair)
        same = pair[order][1:] == pair[order][:-1]
        again = np.zeros(len(order), bool)
        again[1:] |= same
        again[:-1] |= same
        hit[active[order[again]], o] = True
    edge = np.diff(np.concatenate([np.zeros((n, 1), np.int8), hit.view(np.int8)], axis=1), axis=1)
    row, first = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    return row, first, end - 1


def _sorted_buckets(size: int = BUCKET):
    """Rows come by bucket and leading tokens. A bucket is cut where leading tokens change into
    stretches of about `size` rows, and each is sorted. Known spans pass through."""
    return lean(lambda batches: _sort_stretches(batches, size))


def _sort_stretches(batches, size: int):
    schema = pa.schema([("key", pa.binary()), ("start", pa.int64()), ("stop", pa.int64())])
    held: list[pa.Table] = []
    last = None
    waiting, before = 0, b""

    def flood(blobs):
        record = np.frombuffer(b"".join(blobs), _RECORD)
        order = np.lexsort((record["b"], record["a"]))
        same = (record["a"][order][1:] == record["a"][order][:-1]) & (record["b"][order][1:] == record["b"][order][:-1])
        again = np.zeros(len(order), bool)
        again[1:] |= same
        again[:-1] |= same
        some = record[order[again]]
        for i in range(0, len(some), 50_000):
            r = some[i : i + 50_000]
            keys = pa.Array.from_buffers(pa.binary(16), len(r), [None, pa.py_buffer(np.ascontiguousarray(r["key"]).tobytes())]).cast(pa.binary())
            start = r["start"].astype(np.int64)
            yield pa.RecordBatch.from_arrays([keys, pa.array(start), pa.array(start + WIDTH)], schema=schema)

    def flush():
        t = pa.concat_tables(held).combine_chunks()
        if last < 0:
            yield from flood(t.column("around").to_pylist())
            return
        at, most, least = (np.asarray(t.column(c), np.int64) for c in ("at", "most", "least"))
        row, first, end = repeated(t.column("around").to_pylist(), most, least)
        keys = t.column("key").combine_chunks()
        for i in range(0, len(row), 50_000):
            r = row[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(r)), pa.array(at[r] - end[i : i + 50_000]), pa.array(at[r] - first[i : i + 50_000] + WIDTH)], schema=schema)

    for batch in batches:
        known = batch.filter(batch.column("around").is_null())
        if known.num_rows:
            yield known.select(["key", "start", "stop"]).cast(schema)
        rest = batch.filter(batch.column("around").is_valid())
        bucket = np.asarray(rest.column("bucket"))
        leads = [x[m : m + LEAD] if m is not None else b"" for x, m in zip(rest.column("around").to_pylist(), rest.column("most").to_pylist(), strict=True)]
        if not leads:
            continue
        new = np.flatnonzero([x != y for x, y in zip(leads, [before, *leads[:-1]], strict=True)])
        changes = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
        at = 0
        while at < len(bucket):
            # as far as the bucket goes, and no further than the first change of tokens past the size
            end = int(changes[i]) if (i := np.searchsorted(changes, at, "right")) < len(changes) else len(bucket)
            if bucket[at] != last and held:
                yield from flush()
                held, waiting = [], 0
            elif waiting >= size and last >= 0 and (j := np.searchsorted(new, at)) < len(new) and new[j] == at:
                yield from flush()
                held, waiting = [], 0
            last = bucket[at]
            if last >= 0 and waiting + end - at > size:
                j = np.searchsorted(new, at + max(size - waiting, 1))
                end = min(end, int(new[j])) if j < len(new) else end
            held.append(pa.Table.from_batches([rest.slice(at, end - at)]))
            waiting, before, at = waiting + end - at, leads[end - 1], end
    if held:
        yield from flush()


@lean
def _cut(batches):
    """Each text without its spans."""
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        raw = data.tobytes()
        copies, spans = batch.column("n").to_pylist(), batch.column("spans")
        starts = spans.flatten().field(0) if len(spans) else None
        stops = spans.flatten().field(1) if len(spans) else None
        lens = np.asarray(spans.value_lengths().fill_null(0), np.int64)
        cuts = np.concatenate([[0], np.cumsum(lens)])
        s_all, e_all = (np.asarray(x, np.int64) if x is not None else np.zeros(0, np.int64) for x in (starts, stops))
        out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        for i in range(batch.num_rows):
            text = raw[offsets[i] : offsets[i + 1]]
            if copies[i] > 1 and len(text) >= WIDTH:
                kept, runs = b"", 1
            else:
                s, e = s_all[cuts[i] : cuts[i + 1]], e_all[cuts[i] : cuts[i + 1]]
                order = np.argsort(s, kind="stable")
                kept_parts, at, end, runs = [], 0, -1, 0
                for a, b in zip(s[order].tolist(), e[order].tolist(), strict=True):
                    if a > end:
                        kept_parts.append(text[at:a])
                        runs += 1
                    end = max(end, b)
                    at = end
                kept_parts.append(text[at:])
                kept = b"".join(kept_parts)
            out["n_bytes"].append(len(text))
            out["n_removed"].append(len(text) - len(kept))
            out["n_spans"].append(runs)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept"].append(kept.decode("utf-8", "ignore"))
        yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(v) for v in out.values())], ["key", *out])


def cut_repeats(docs: DataFrame, hot: int = HOT, bucket: int = BUCKET, common: int = COMMON) -> DataFrame:
    """key (the text's MD5), n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes
    that remain, as text; a character cut in two is left out) of each distinct text."""
    # the key is never null and n goes along everywhere, so that all three readers of the
    # texts are the same plan and their one shuffle is reused
    key = F.coalesce(F.unhex(F.md5(F.encode("text", "UTF-8"))), F.lit(b""))
    keyed = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text")).select(key.alias("key"), "text")
    texts = keyed.groupBy("key").agg(F.count("*").alias("n"), F.first("text").alias("text"))
    rows, total = keyed.select(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    sample = keyed.select("text").sample(min(1.0, SAMPLE / max(rows, 1)), seed=7).mapInArrow(_sampled, "gram long, lead binary")
    often = max(common, hot * min(1.0, SAMPLE / max(rows, 1)))
    sampled = sample.groupBy("gram", "lead").count().where((F.col("count") >= often) | F.col("gram").isNull()).collect()
    shared = np.array([r.gram for r in sampled if r.gram is not None], np.int64).view(np.uint64)
    leads = np.sort(np.array([bytes(r.lead) for r in sampled if r.gram is None for _ in range(r["count"])], f"S{LEAD}"))
    ranges = max(1, min(len(leads), SPLITTERS, total // (76 * bucket)))
    splitters = np.unique(leads[(np.arange(1, ranges) * len(leads)) // ranges]) if ranges > 1 else leads[:0]
    found = texts.mapInArrow(_find_anchors(shared), "key binary, found array<struct<place:long,gram:long,kind:int>>")
    each = found.select("key", F.explode("found").alias("x")).select("key", "x.*")
    met = F.count("*").over(Window.partitionBy("gram"))
    known = F.when(F.col("kind").bitwiseAND(HEAD | AGAIN) > 0, KNOWN).otherwise(0)
    rival = F.when(F.col("kind") >= SHARED, FLOOD).when(F.col("kind") >= AGAIN, 0).when(F.col("met") > hot, FLOOD).when(F.col("met") > 1, SEND).otherwise(0)
    todo = each.withColumn("met", met).select("key", "place", (known + rival).cast("int").alias("act")).where("act > 0")
    listed = todo.groupBy("key").agg(F.collect_list(F.struct("place", "act")).alias("todo"))
    contexts = texts.join(listed, "key").mapInArrow(
        _contexts(splitters, max(16, total >> 20)), "bucket int, key binary, at long, most int, least int, around binary, start long, stop long"
    )
    lead = F.col("around").substr(F.col("most") + 1, F.lit(LEAD))
    spans = contexts.repartition("bucket").sortWithinPartitions("bucket", lead).mapInArrow(_sorted_buckets(bucket), "key binary, start long, stop long")
    listed = spans.groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    none = F.array().cast("array<struct<start:long,stop:long>>")
    ready = texts.join(listed, "key", "left").select("key", "n", "text", F.coalesce("spans", none).alias("spans"))
    return ready.mapInArrow(_cut, "key binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")


def report(docs: DataFrame, hot: int = HOT, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of docs."""
    key = F.unhex(F.md5(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8"))).alias("key")
    return docs.select("doc_id", key).join(cut_repeats(docs, hot, bucket).drop("kept"), "key").drop("key")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with their texts cut."""
    key = F.unhex(F.md5(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")))
    # the other columns go along in one, so that no name can clash
    others = docs.select(key.alias("key"), F.struct(*(F.lit(None).cast("string").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    joined = others.join(cut_repeats(docs).select("key", "kept"), "key")
    return joined.select(*(F.col("kept").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
