"""Language-model scoring with a weighted backoff automaton.

The model is an n-gram model under Dirichlet smoothing: of a history v, with count c(v),

    p(w | v) = (c(vw) + K * p(w | shorter v)) / (c(v) + K),   p(w) = (c(w) + 1) / (N + V + 1),

where K is that of the order of vw. As an automaton, a state is a history met in training;
an n-gram met is an arc of weight log10 p(w | v) to the longest history that ends it; every
other word follows the failure arc of weight log10(K / (c(v) + K)) to the state of the
shorter history, down to the root, where the unigrams and the unknown word are. A text is
one traversal from left to right from the state of its start, which carries the state and
adds up weights. `Automaton` holds the arcs, failure arcs and states; `traverse` is the walk.

A corpus's automaton does not fit in memory, so its arcs stay distributed. A first pass counts
the training tokens, N, and their distinct words, V. Documents are dealt into blocks of bounded
bytes. A block sends the distinct n-grams on its paths, hashed, with their counts in its
training documents, to shards by hash range; a shard adds up the counts of all blocks and
answers each block that asked it in that block's order, and says of each n-gram whether more
blocks than one asked. Orders above 2 are asked one after the other: an n-gram is in two blocks
only if its first and its last words, one fewer, are, so a block keeps to itself the n-grams
for which that does not hold, and knows their counts. The block then builds the automaton of
all arcs that its texts can take, and walks them. What is exchanged is one entry for each
distinct n-gram of a block, in no more messages than entries, so a frequent n-gram costs a
shard no more than the number of blocks. No n-gram is pruned.

An order's K is the value of STRENGTHS with the greatest leave-one-out likelihood of all
training tokens, with the lower orders' K as they were chosen before.

Cases: a null or empty text is its end token alone; null ids are trained on; repeated rows
are counted and scored as often as they stand; an empty table gives no rows; texts are
taken whole; other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, buffers, crc32_of, drop_stored, give_back, hash_spans, lean, pieces, splitmix, stored, words

ORDER, BLOCK_BYTES, SHARD_ENTRIES, LANE = 3, 8 << 20, 1 << 20, 512
BLOCKS_A_TASK = 8
STRENGTHS = (1.0, 8.0, 64.0, 512.0, 4096.0, 32768.0)
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ASIDE = 256  # shards below 0, for what passes through


class Paths:
    """The n-grams on the paths of a block's texts. For each order k, counted from 1: at[k],
    the positions that have one; of[k], the number of each position's, or -1; keys[k],
    ascending; counts[k], in training, own or all blocks'; shared[k], whether another block
    has it too. A start mark leads each text and ends no n-gram."""

    def __init__(self, docs, order: int):
        token, self.bounds = _tokens(docs.column("text"))
        self.held = ~np.asarray(docs.column("train"))
        self.n = len(token)
        self.train = np.repeat(~self.held, np.diff(self.bounds))
        self.keys, self.of, self.counts, self.shared = [None], [None], [None], [None]
        for at, gram in _grams(token, self.bounds, order):
            keys, which = np.unique(gram, return_inverse=True)
            of = np.full(self.n, -1, np.int32)
            of[at] = which
            self.keys.append(keys)
            self.of.append(of)
            self.counts.append(np.bincount(which[self.train[at]], minlength=len(keys)))
            self.shared.append(np.ones(len(keys), bool))

    def member(self, k: int) -> np.ndarray:
        """A position of each n-gram of order k."""
        out = np.zeros(len(self.keys[k]), np.int64)
        at = np.flatnonzero(self.of[k] >= 0)
        out[self.of[k][at]] = at
        return out

    def before(self, k: int) -> np.ndarray:
        """The number of the history of order k that each position's word follows, or -1."""
        out = np.full(self.n, -1, np.int32)
        out[1:] = self.of[k][:-1]
        out[self.bounds[:-1]] = -1
        return out

    def asked(self, k: int) -> np.ndarray:
        """Which n-grams of order k another block may have."""
        if k < 3:
            return np.ones(len(self.keys[k]), bool)
        at = self.member(k)
        return self.shared[k - 1][self.of[k - 1][at]] & self.shared[k - 1][self.before(k - 1)[at]]

    def learn(self, answers, to: int) -> None:
        """Counts of all blocks, from the shards' answers, for orders up to `to`."""
        order_of, shard, width = (np.asarray(answers.column(c)) for c in ("gram_order", "shard", "width"))
        blobs = answers.column("totals")
        for k in range(1, to + 1):
            asked = self.asked(k)
            rows = np.flatnonzero(order_of == k)
            rows = rows[np.argsort(shard[rows])]
            self.shared[k] = np.zeros(len(asked), bool)
            if len(rows):
                known = np.concatenate([_from_planes(blobs[int(r)].as_py(), np.uint32 if width[r] == 4 else np.int64).astype(np.int64) for r in rows])
                self.counts[k][asked] = known >> 1
                self.shared[k][asked] = (known & 1).astype(bool)

    def likelihoods(self, k: int, fixed: tuple[float, ...], strengths: tuple[float, ...], floor: int, texts: int) -> np.ndarray:
        """The training tokens' leave-one-out likelihood in orders up to k, a row for each
        training text and a column for each strength of order k; fixed: those of order 2 on."""
        some = np.flatnonzero(self.train)
        out = np.zeros((len(self.held), len(strengths)))
        if not len(some):
            return out
        p = self.counts[1][self.of[1][some]] / (floor - 1)
        starts = np.concatenate([[0], np.cumsum(np.diff(self.bounds)[~self.held])[:-1]])
        for j in range(2, k + 1):
            has = self.of[j][some] >= 0  # what stands beside it elsewhere is not taken
            c = self.counts[j][self.of[j][some]] - 1
            if j == 2:
                h = self.before(1)[some]
                history = np.where(h >= 0, self.counts[1][h], texts) - 1
            else:
                history = self.counts[j - 1][self.before(j - 1)[some]] - 1
            if j < k:
                with np.errstate(all="ignore"):
                    p = np.where(has, (c + fixed[j - 2] * p) / (history + fixed[j - 2]), p)
            else:
                for i, s in enumerate(strengths):
                    with np.errstate(all="ignore"):
                        out[~self.held, i] = np.add.reduceat(np.log10(np.where(has, (c + s * p) / (history + s), p)), starts)
        return out


class Automaton:
    """The automaton of all arcs on some paths. States: 0 is the root, 1 the start of a text,
    then the histories met, by order. arc[k], of the n-grams of order k: weight and next
    state; fail, of the states: weight and next state. The highest order's weights have a
    column for each of its strengths."""

    def __init__(self, paths: Paths, order: int, fixed: tuple[float, ...], strengths: tuple[float, ...], floor: int, texts: int):
        self.order, self.unknown = order, np.log10(1 / floor)
        self.state_of = [None]  # by order, of each n-gram as a history
        n = 2
        for k in range(1, order):
            met = paths.counts[k] > 0
            self.state_of.append(np.where(met, n + np.cumsum(met) - 1, 0))
            n += int(met.sum())
        self.start = 1 if order > 1 and texts else 0
        self.depth = np.zeros(n, np.int8)
        self.depth[1] = 1
        self.fail_to = np.zeros(n, np.int64)
        self.fail = np.zeros(n)  # of the states below the highest order
        self.fail_last = np.zeros((n, len(strengths)))
        self.arc, self.arc_to = [None], [None]
        choice = np.asarray(strengths)

        def lost(state, history, k):
            """Failure weights of states whose arcs are n-grams of order k."""
            if k == order:
                self.fail_last[state] = np.log10(choice / (history[:, None] + choice))
            else:
                self.fail[state] = np.log10(fixed[k - 2] / (history + fixed[k - 2]))

        if self.start:
            lost(np.array([1]), np.array([texts]), 2)
        chance = (paths.counts[1] + 1) / floor
        for k in range(1, order + 1):
            met = np.flatnonzero(paths.counts[k])
            at = paths.member(k)[met]
            if k == 1:
                p = chance[met]
            else:
                lower = chance[paths.of[k - 1][at]]
                h = paths.before(k - 1)[at]
                history = np.where(h >= 0, paths.counts[k - 1][h], texts)
                s = choice if k == order else fixed[k - 2]
                p = (paths.counts[k][met] + s * lower) / (history + s) if k < order else (paths.counts[k][met][:, None] + s * lower[:, None]) / (history[:, None] + s)
            weight = np.zeros((len(paths.keys[k]), *p.shape[1:]))
            weight[met] = np.log10(p)
            to = np.zeros(len(paths.keys[k]), np.int64)
            if order > 1:
                to[met] = self.state_of[min(k, order - 1)][(paths.of[order - 1][at] if k == order else met)]
            self.arc.append(weight)
            self.arc_to.append(to)
            if k < order:
                chance = np.zeros(len(paths.keys[k]))
                chance[met] = p
                own = self.state_of[k][met]
                self.depth[own] = k
                lost(own, paths.counts[k][met], k + 1)
                if k > 1:
                    self.fail_to[own] = self.state_of[k - 1][paths.of[k - 1][at]]


def traverse(paths: Paths, own: Automaton, lane: int = LANE) -> np.ndarray:
    """Log-probabilities of the texts, a column for each strength of the highest order. All
    texts, end to end, are cut into lanes that are walked side by side, each from left to
    right with its own state. As no state is longer than order - 1 words, a lane that starts
    so many words early, at the root, has come to the right state where its own words begin."""
    n, order = paths.n, own.order
    columns = own.fail_last.shape[1]
    total = np.zeros((len(paths.held), columns))
    if not n:
        return total
    opens = np.zeros(n + 1, bool)
    opens[paths.bounds[:-1]] = True
    text = np.repeat(np.arange(len(paths.held)), np.diff(paths.bounds))
    met = [None] + [np.where(of >= 0, counts[of] > 0, False) for of, counts in zip(paths.of[1:], paths.counts[1:], strict=True)]
    first = np.arange(0, n, lane)
    stop = np.minimum(first + lane, n)
    state, gain = np.zeros(len(first), np.int64), np.zeros((len(first), columns))
    for t in range(-(order - 1), lane):
        at = first + t
        live = np.flatnonzero((at >= 0) & (at < stop))
        at = at[live]
        if not len(at):
            continue
        state[live[opens[at]]] = own.start
        for d in range(order - 1, 0, -1):
            lost = (own.depth[state[live]] == d) & ~met[d + 1][at]
            if lost.any():
                which = live[lost]
                gain[which] += own.fail_last[state[which]] if d + 1 == order else own.fail[state[which], None]
                state[which] = own.fail_to[state[which]]
        deep = own.depth[state[live]]
        for d in range(order):
            here = deep == d
            if here.any():
                which, place = live[here], at[here]
                gram = paths.of[d + 1][place]
                weight, to = own.arc[d + 1][gram], own.arc_to[d + 1][gram]
                if not d:
                    seen = met[1][place]
                    weight, to = np.where(seen if weight.ndim == 1 else seen[:, None], weight, own.unknown), np.where(seen, to, 0)
                gain[which] += weight if weight.ndim == 2 else weight[:, None]
                state[which] = to
        if t < 0:
            gain[:] = 0.0
        else:
            done = opens[at + 1] | (at + 1 == stop[live])
            which = live[done]
            np.add.at(total, text[at[done]], gain[which])
            gain[which] = 0.0
    return total


def _tokens(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, each with its end, and the texts' bounds."""
    raw, offsets = buffers(column)
    parts, sizes = [], []
    for a, b in pieces(offsets, 1 << 21):
        data, at = LOWER[raw[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
        starts, ends, row = words(data, at)
        out = np.full(len(starts) + b - a, END, np.uint64)
        out[np.arange(len(starts)) + row] = hash_spans(data, starts, ends)
        parts.append(out)
        sizes.append(np.bincount(row, minlength=b - a) + 1)
    size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(size)])


def _grams(token: np.ndarray, bounds: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order, the positions that have an n-gram of it and its key there. A text
    is led by one start mark, which ends no n-gram."""
    place = np.arange(len(token)) - np.repeat(bounds[:-1], np.diff(bounds))
    out = [(np.arange(len(token)), splitmix(token))]
    with np.errstate(over="ignore"):
        for k in range(2, order + 1):
            at = np.flatnonzero(place >= k - 2)
            key = np.full(len(at), np.uint64(k), np.uint64)
            for j in range(k - 1, -1, -1):
                t = token[np.maximum(at - j, 0)]
                if j == k - 1:
                    t = np.where(place[at] == k - 2, START, t)
                key = splitmix(key * _STEP + t)
            out.append((at, key))
    return out


def _planes(values: np.ndarray) -> bytes:
    """The values' first bytes, then their second ones and so on: where most are small,
    long runs of zeros, which a shuffle's compression takes away."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def _from_planes(blob: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _rising(keys: np.ndarray) -> bytes:
    """Ascending keys, as planes of their differences."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _cells(keys: np.ndarray, bits: int):
    """Shard, first and last place of ascending keys, for shards that have some."""
    if not len(keys):
        return
    shard = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    cuts = np.flatnonzero(np.diff(shard)) + 1
    yield from zip(shard[np.append(0, cuts)].tolist(), [0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True)


def _training_words(bits: int):
    """Distinct words of training texts, and how many tokens there are."""

    @lean
    def run(batches):
        held, n = [], 0

        def rows():
            cells = list(_cells(keys := np.unique(np.concatenate(held)), bits))
            tokens = [n] + [0] * (len(cells) - 1)
            return pa.RecordBatch.from_arrays([pa.array([c[0] for c in cells], pa.int32()), pa.array(tokens, pa.int64()), pa.array([_rising(keys[a:b]) for _, a, b in cells], pa.binary())], ["shard", "tokens", "keys"])

        for batch in batches:
            token, _ = _tokens(batch.column("text").filter(batch.column("train")))
            n += len(token)
            held.append(np.unique(splitmix(token)))
            if sum(map(len, held)) > 1 << 21:
                held = [np.unique(np.concatenate(held))]
                if len(held[0]) > 1 << 20:
                    yield rows()
                    held, n = [], 0
        if n:
            yield rows()

    return run


def _distinct(asked):
    keys = [np.cumsum(_from_planes(b, np.uint64), dtype=np.uint64) for b in asked.column("keys").to_pylist()]
    return pa.table({"tokens": pa.array([np.asarray(asked.column("tokens")).sum()], pa.int64()), "kinds": pa.array([len(np.unique(np.concatenate(keys)))], pa.int64())})


_ASKED = "gram_order int, shard int, block long, keys binary, counts binary, likelihoods array<double>"
_ANSWERED = "block long, gram_order int, shard int, width int, totals binary, likelihoods array<double>"


def _ordered(docs):
    return docs.sort_by([("tie", "ascending"), ("doc_id", "ascending")])


def _questions(paths: Paths, orders, block: int, bits: int, likelihoods: np.ndarray | None = None):
    cols = [[], [], [], [], [], []]
    for k in orders:
        asked = paths.asked(k)
        keys, counts = paths.keys[k][asked], paths.counts[k][asked].astype(np.uint32)
        for s, a, b in _cells(keys, bits):
            for c, v in zip(cols, (k, s, block, _rising(keys[a:b]), _planes(counts[a:b]), None), strict=True):
                c.append(v)
    if likelihoods is not None:
        for c, v in zip(cols, (orders[-1], -1 - block % _ASIDE, block, b"", b"", likelihoods.tolist()), strict=True):
            c.append(v)
    types = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.float64()))
    return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["gram_order", "shard", "block", "keys", "counts", "likelihoods"])


def _ask(order: int, bits: int):
    """N-grams of order 1 and, if order is higher, 2."""

    def run(key, docs):
        give_back()
        return _questions(Paths(_ordered(docs), min(order, 2)), range(1, min(order, 2) + 1), key[0].as_py(), bits)

    return run


def _ask_on(k: int, bits: int, fixed: tuple[float, ...], strengths: tuple[float, ...], floor: int, texts: int):
    """N-grams of order k of a block that knows its lower ones; and how likely its training
    tokens are in order k - 1."""

    def run(key, docs, answers):
        give_back()
        paths = Paths(_ordered(docs), k)
        paths.learn(answers, k - 1)
        return _questions(paths, [k], key[0].as_py(), bits, paths.likelihoods(k - 1, fixed, strengths, floor, texts).sum(axis=0))

    return run


def _answer(asked):
    if asked.column("shard")[0].as_py() < 0:
        n = asked.num_rows
        return pa.table({"block": asked.column("block"), "gram_order": asked.column("gram_order"), "shard": asked.column("shard"), "width": pa.array(np.zeros(n, np.int32)), "totals": pa.nulls(n, pa.binary()), "likelihoods": asked.column("likelihoods")})
    parts = [np.cumsum(_from_planes(b, np.uint64), dtype=np.uint64) for b in asked.column("keys").to_pylist()]
    cuts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    keys, which = np.unique(np.concatenate(parts), return_inverse=True)
    del parts
    counts = np.concatenate([_from_planes(b, np.uint32) for b in asked.column("counts").to_pylist()])
    both = np.bincount(which, counts, len(keys)).astype(np.int64) * 2 + (np.bincount(which, minlength=len(keys)) > 1)
    mine = both[which]
    wide = mine.astype(np.uint32) if mine.max() < 1 << 32 else mine
    return pa.table(
        {
            "block": asked.column("block"),
            "gram_order": asked.column("gram_order"),
            "shard": asked.column("shard"),
            "width": pa.array(np.full(asked.num_rows, wide.itemsize, np.int32)),
            "totals": pa.array([_planes(wide[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
            "likelihoods": pa.nulls(asked.num_rows, pa.list_(pa.float64())),
        }
    )


_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, scores array<double>, likelihoods array<double>"


def _score(order: int, fixed: tuple[float, ...], strengths: tuple[float, ...], total: int, kinds: int, texts: int):
    floor = total + kinds + 1

    def run(docs, answers):
        give_back()
        docs = _ordered(docs)
        paths = Paths(docs, order)
        paths.learn(answers, order)
        del answers
        scores = traverse(paths, Automaton(paths, order, fixed, strengths, floor, texts))
        one = paths.counts[1][paths.of[1]]
        add = lambda x: np.add.reduceat(x, paths.bounds[:-1]) if len(x) else np.zeros(0)
        lists = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(strengths)).cast(pa.list_(pa.float64()))
        return pa.table(
            {
                "doc_id": docs.column("doc_id"),
                "held_out": pa.array(paths.held),
                "n_tokens": pa.array(np.diff(paths.bounds)),
                "n_known": pa.array(add((one > 0).astype(np.int64)).astype(np.int64)),
                "train_tokens": pa.array(np.full(len(paths.held), total)),
                "base_score": pa.array(add(np.log10((one + 1) / floor))),
                "scores": lists(scores),
                "likelihoods": lists(paths.likelihoods(order, fixed, strengths, floor, texts)),
            }
        )

    return run


def held_out(doc_id):
    return F.coalesce(crc32_of(doc_id) % 7 == 2, F.lit(False))


def _best(found: DataFrame, strengths: tuple[float, ...]) -> int:
    sums = found.select(*(F.sum(F.get("likelihoods", F.lit(i))).alias(str(i)) for i in range(len(strengths)))).first()
    return int(np.argmax([x if x is not None else -np.inf for x in sums]))


def scores(docs: DataFrame, order: int = ORDER, strengths: tuple[float, ...] = STRENGTHS, block_bytes: int = BLOCK_BYTES, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, strengths (of
    the orders from 2 on)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    size, texts = docs.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if(~held_out(F.col("doc_id")))).first()
    blocks = max(1, -(-size // block_bytes))
    bits = max(0, (size // 4 // shard_entries).bit_length())
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-blocks // BLOCKS_A_TASK))
    dealt = docs.select(
        "doc_id", "text", (~held_out(F.col("doc_id"))).alias("train"), F.xxhash64("text").alias("tie"), F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(blocks)).cast("long").alias("block")
    )
    found_words = dealt.select("text", "train").mapInArrow(_training_words(bits), "shard int, tokens long, keys binary")
    total, kinds = found_words.groupBy("shard").applyInArrow(_distinct, "tokens long, kinds long").select(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "kinds"))).first()

    def answered(asked: DataFrame) -> DataFrame:
        return stored(asked.repartition(tasks, "gram_order", "shard").groupBy("gram_order", "shard").applyInArrow(_answer, _ANSWERED), "lm-answers")

    def met(answers: list[DataFrame]):
        every = answers[0]
        for more in answers[1:]:
            every = every.unionByName(more.where("shard >= 0"))
        every = every.select("block", "gram_order", "shard", "width", "totals")
        return in_blocks.groupBy("block").cogroup(every.repartition(tasks, "block").groupBy("block"))

    in_blocks = dealt.repartition(tasks, "block")
    known, fixed = [answered(in_blocks.groupBy("block").applyInArrow(_ask(order, bits), _ASKED))], ()
    for k in range(3, order + 1):
        known.append(answered(met(known).applyInArrow(_ask_on(k, bits, fixed, strengths, total + kinds + 1, texts), _ASKED)))
        fixed += (strengths[_best(known[-1].where("shard < 0"), strengths)],)
    found = stored(met(known).applyInArrow(_score(order, fixed, strengths, total, kinds, texts), _OUT), "lm-scores")
    drop_stored(*known)
    best = _best(found, strengths)
    chosen = F.array(*map(F.lit, [*fixed, strengths[best]] if order > 1 else []))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", F.get("scores", F.lit(best)).alias("score"), chosen.cast("array<double>").alias("strengths"))
