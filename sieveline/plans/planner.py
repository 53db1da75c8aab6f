"""How a request is answered: by the index where that is safe, else by a full scan, and why.

The index only narrows the files; every route checks the lines themselves, so both give
the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import globs, regexes
from ..request import SearchRequest
from ..sources.index import FOLDED_LETTERS, HELD_IDS, Index

#: Files are named to the scan if they are at most this share of all; more are read anyway.
SELECTIVE = 1 / 3
#: Ids are pushed to the scan as so many ranges at most, and up to so many as a list.
RANGES, LISTED = 64, 1000
WORD = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")


@dataclass(frozen=True)
class Plan:
    """route: index, scan, empty or invalid. reason: why it isn't by index. gram: the
    rarest mandatory gram; required: all that were looked up; df: files that have the rarest."""

    route: str
    reason: str | None = None
    gram: str | None = None
    required: tuple[str, ...] = ()
    df: int | None = None
    blockers: bool = False


def unsupported(request: SearchRequest) -> str | None:
    """The first reason why the index can't serve a request."""
    if request.multiline:
        return "multiline"
    if request.no_ignore:
        return "no_ignore"
    if not request.literal:
        return None
    if request.ignore_case and not request.pattern.isascii():
        return "non_ascii_case_fold"
    data = request.pattern.encode()
    if len(data) < 3:
        return "literal_too_short"
    if any(c in data for c in (0, 10, 13)):
        return "literal_with_line_break"
    return None


def usable(grams: set[bytes]) -> tuple[str, ...]:
    return tuple(sorted(g.decode() for g in grams if all(b in WORD for b in g)))


def required_grams(request: SearchRequest) -> tuple[str, ...]:
    """Indexed grams that each match must hold; folded ones if case is ignored."""
    if request.literal:
        data = request.pattern.encode()
        return usable(regexes.grams_of(data.lower() if request.ignore_case else data))
    return usable(regexes.mandatory_grams(regexes.parse(request.pattern, request.ignore_case)))


def case_variants(gram: str) -> list[str]:
    return sorted({"".join(x) for x in product(*((c.lower(), c.upper()) for c in gram))})


def plan(request: SearchRequest, index: Index | None) -> Plan:
    if not request.literal:
        try:
            regexes.parse(request.pattern, request.ignore_case)
        except regexes.InvalidRegex as why:
            return Plan("invalid", str(why))
    if index is None:
        return Plan("scan", "no_index")
    reason = unsupported(request)
    if reason:
        return Plan("scan", reason)
    wanted = required_grams(request)
    if not wanted:
        return Plan("scan", "no_indexed_gram")
    # ASCII folding misses two letters outside ASCII that fold to k and s
    blockers = request.ignore_case and any(c in "ks" for c in request.pattern.lower())
    known = index.frequencies
    df = {g: sum(known.get(v, 0) for v in (case_variants(g) if request.ignore_case else [g])) for g in wanted}
    found = sorted((n, g) for g, n in df.items() if n)
    if len(found) < len(wanted) and not blockers:
        return Plan("empty", None, None, wanted, 0)
    if len(found) < len(wanted):
        return Plan("index", None, None, wanted, 0, blockers)
    return Plan("index", None, found[0][1], wanted, found[0][0], blockers)


def _variants(plan_: Plan, request: SearchRequest, gram: str) -> list[str]:
    return case_variants(gram) if request.ignore_case else [gram]


def rarest_candidates(plan_: Plan, request: SearchRequest, index: Index) -> DataFrame:
    """Ids of the files that have the rarest gram, whatever their number."""
    if plan_.gram is None:
        return index.paths.select("file_id").limit(0)
    ids = index.parts_of(_variants(plan_, request, plan_.gram)).select(F.explode("ids").alias("file_id"))
    return ids.distinct() if request.ignore_case else ids


def named(plan_: Plan, request: SearchRequest, index: Index) -> np.ndarray | None:
    """Ids of the files that have all required grams, where the rarest one's list may be held:
    further lists only make fewer of them, and those too long to be held are left out."""
    if plan_.gram is None:
        ids = np.zeros(0, np.int64)
    else:
        known = index.frequencies
        size = {g: sum(known.get(v, 0) for v in _variants(plan_, request, g)) for g in plan_.required}
        if size[plan_.gram] > HELD_IDS:
            return None
        use, room = [], 4 * HELD_IDS
        for g in sorted(plan_.required, key=lambda g: (size[g], g)):
            if size[g] <= HELD_IDS and (room := room - size[g]) >= 0:
                use.append(g)
        lists = index.ids_of(sorted({v for g in use for v in _variants(plan_, request, g) if v in known}))
        ids = None
        for g in use:
            own = np.unique(np.concatenate([lists[v] for v in _variants(plan_, request, g) if v in lists]))
            ids = own if ids is None else np.intersect1d(ids, own, assume_unique=True)
    if plan_.blockers:
        ids = np.union1d(ids, index.ids_of([FOLDED_LETTERS])[FOLDED_LETTERS])
    return ids


def _by_path(request: SearchRequest, index: Index) -> np.ndarray | None:
    """Ids of the files whose paths a scope or glob takes, if they are few; without texts."""
    if request.path is None and request.glob is None:
        return None
    few = int(min(HELD_IDS, index.size * SELECTIVE))

    def look():
        got = visible(index.paths, request).select("file_id").limit(few + 1).toArrow().column("file_id")
        return None if len(got) > few else np.unique(np.asarray(got.combine_chunks(), np.int64))

    return index.held(("path", request.path, request.glob, request.hidden, request.no_ignore), look)


def ranges(ids: np.ndarray, most: int = RANGES) -> list[tuple[int, int]]:
    """The fewest and narrowest ranges over rising ids: cut at the widest gaps."""
    if not len(ids):
        return []
    gaps = np.diff(ids.astype(object) if len(ids) and (int(ids[-1]) - int(ids[0])) >= 2**63 else ids)
    cut = np.sort(np.argsort(-gaps.astype(np.float64), kind="stable")[: most - 1])
    cut = cut[[gaps[i] > 1 for i in cut]] if len(cut) else cut
    return list(zip(ids[np.append(0, cut + 1)].tolist(), ids[np.append(cut, len(ids) - 1)].tolist(), strict=True))


def at_ids(index: Index, ids: np.ndarray) -> DataFrame:
    """The index's files with these rising ids. Parts are chosen by their folders and pages by
    ranges of ids; then the ids themselves decide."""
    if not len(ids):
        return index.files.limit(0)
    near = F.expr(" OR ".join(f"file_id = {a}L" if a == b else f"(file_id >= {a}L AND file_id <= {b}L)" for a, b in ranges(ids)))
    parts = index.parts_at(ids)
    some = index.files.where(near)
    if len(parts) < min(len(index.parts), LISTED):
        some = some.where(F.col("part").isin(*parts.tolist()))
    if len(ids) <= LISTED:
        return some.where("file_id IN (" + ", ".join(f"{i}L" for i in ids.tolist()) + ")")
    return some.join(F.broadcast(index.files.sparkSession.createDataFrame(pa.table({"file_id": ids}))), "file_id", "left_semi")


def candidates(plan_: Plan, request: SearchRequest, index: Index) -> DataFrame:
    """Ids of the files that may match, by content."""
    ids = named(plan_, request, index) if plan_.route == "index" else np.zeros(0, np.int64)
    if ids is None:
        ids = rarest_candidates(plan_, request, index)
        return ids.union(index.parts_of([FOLDED_LETTERS]).select(F.explode("ids"))).distinct() if plan_.blockers else ids
    return index.files.sparkSession.createDataFrame(pa.table({"file_id": ids}))


def narrowed(plan_: Plan, request: SearchRequest, index: Index) -> DataFrame:
    """The index's files that a plan leaves to look at: those that its grams and its paths name,
    if they are few enough to be worth it. Lists too long to be held are joined by shuffle."""
    if plan_.route == "empty":
        return index.files.limit(0)
    by_path = _by_path(request, index)
    if plan_.route != "index":
        return index.files if by_path is None else at_ids(index, by_path)
    ids = named(plan_, request, index)
    if by_path is not None:
        ids = by_path if ids is None else np.intersect1d(ids, by_path, assume_unique=True)
    if ids is not None:
        return at_ids(index, ids) if len(ids) <= index.size * SELECTIVE else index.files
    if plan_.df > index.size * SELECTIVE:
        return index.files
    return index.files.join(candidates(plan_, request, index), "file_id", "left_semi")


def visible(files: DataFrame, request: SearchRequest) -> DataFrame:
    """Files by path scope, glob, visibility and ignore rules; cheap, and before content."""
    path = F.col("path")
    out = files.where(globs.in_scope(path, request.path) & ~globs.left_out(path) & globs.matches(path, request.glob))
    for text in globs.mandatory_literals(request.glob):
        out = out.where(F.lower(path).contains(text.lower()))
    if not request.hidden:
        out = out.where(~globs.is_hidden(path))
    if not request.no_ignore and "ignored" in files.columns:
        out = out.where(~F.col("ignored"))
    return out
