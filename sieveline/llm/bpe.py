"""Byte-level BPE ids of whole batches.

The pre-tokens of a batch (the words that the tokenizer's pattern cuts a text into) are
found by character classes over arrays of code points; each distinct one is encoded once
and kept in a bounded cache, and the ids of a text are gathered from there.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np

from .common import buffers, hash_spans, pieces

_SPACE, _LETTER, _NUMBER, _OTHER, _ODD = 0, 1, 2, 3, 4
_WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_CACHED = 300_000
_ENCODERS: dict[str, "Encoder"] = {}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _classes() -> np.ndarray:
    kinds = {"L": _LETTER, "N": _NUMBER}
    out = np.fromiter((_ODD if (c := unicodedata.category(chr(i))) == "Cn" else kinds.get(c[0], _OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    out[_WHITE] = _SPACE
    return out


def pre_tokens(code: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of texts given as code points; a text is
    code[offsets[i]:offsets[i + 1]]."""
    n = len(code)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes[code]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    turn = first[:n].copy()
    turn[1:] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(turn)
    ends = np.append(runs[1:], n)
    white = kind[runs] == _SPACE
    starts = np.zeros(n + 1, bool)
    starts[runs[white]] = True
    inner = white & ~first[ends]
    starts[ends[inner] - 1] = True
    ink = runs[~white]
    led = (ink > 0) & ~first[ink] & (code[np.maximum(ink - 1, 0)] == 0x20)
    starts[ink[~led]] = True
    # 's 't 'm 'd 're 've 'll, where the quote stands alone and begins a pre-token
    lone = ink[~led & (code[ink] == 0x27) & (ends[~white] == ink + 1) & ~first[ends[~white]]]
    lone = lone[kind[lone + 1] == _LETTER] if len(lone) else lone
    if len(lone):
        after = np.append(code, [0, 0])
        a, b = after[lone + 1], after[lone + 2]
        one = np.isin(a, [0x73, 0x74, 0x6D, 0x64])
        two = ~one & ~first[np.minimum(lone + 2, n)] & (((a == 0x72) & (b == 0x65)) | ((a == 0x76) & (b == 0x65)) | ((a == 0x6C) & (b == 0x6C)))
        for which, size in ((lone[one], 1), (lone[two], 2)):
            starts[which + 1] = False
            rest = which + 1 + size
            rest = rest[rest < n]
            rest = rest[~first[rest] & (kind[rest] == _LETTER)]
            starts[rest] = True
    return np.flatnonzero(starts[:n])


class Encoder:
    """Ids of a byte-level BPE file of the `tokenizers` library."""

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        spec = json.load(open(path, encoding="utf-8"))["model"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(printable)))}
        spelled = {k: i for k, i in spec["vocab"].items() if all(c in byte for c in k)}
        ranks = {bytes(byte[c] for c in k): i for k, i in spelled.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["merges"]]
        order = [spec["vocab"][a + b] for a, b in merges]
        # ids that rise with the merges are ranks; else every word takes the slow way
        self.fast = None
        if order == sorted(order) and not spec.get("ignore_merges") and len(set(ranks.values())) == len(ranks):
            learned = {"".join(m) for m in merges}
            ranks = {w: i for (k, i), w in zip(spelled.items(), ranks, strict=True) if k in learned or len(w) == 1}
            self.fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.classes = _classes()
        self.clear()

    @functools.cached_property
    def slow(self):
        """The library's own encoder, for what the fast way can't take."""
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.path)
        out.encode_special_tokens = True
        return out

    def clear(self) -> None:
        self.slot: dict[int, int] = {}
        self.at = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int32)
        self.flat = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def _word(self, text: str) -> list[int]:
        if self.fast is not None:
            return self.fast.encode_single_piece(text.encode())
        return self.slow.encode(text, add_special_tokens=False).ids

    def _slots(self, hashes: np.ndarray, spell) -> np.ndarray:
        get = self.slot.get
        out = np.array([get(h, -1) for h in hashes.tolist()], np.int64)
        for i in np.flatnonzero(out < 0).tolist():
            ids = self._word(spell(i))
            k = len(self.slot)
            if k >= len(self.at):
                self.at, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size))
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.used : self.used + len(ids)] = ids
            self.at[k], self.size[k] = self.used, len(ids)
            self.used += len(ids)
            self.slot[int(hashes[i])] = k
            out[i] = k
        return out

    def encode(self, column):
        """The ids of each text of a string column, in order, as arrays."""
        raw, offsets = buffers(column)
        for a, b in pieces(offsets, 1 << 20):
            texts = [raw[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace") for i in range(a, b)]
            lens = np.array([len(t) for t in texts], np.int64)
            cut = np.concatenate([[0], np.cumsum(lens)])
            code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
            if len(self.slot) > _CACHED:
                self.clear()
            starts = pre_tokens(code, cut, self.classes)
            ends = np.append(starts[1:], len(code)) if len(starts) else starts
            hashes, first, which = np.unique(hash_spans(code, starts, ends), return_index=True, return_inverse=True)
            whole = "".join(texts)
            slots = self._slots(hashes, lambda i: whole[starts[first[i]] : ends[first[i]]])[which] if len(starts) else np.zeros(0, np.int64)  # noqa: B023
            size = self.size[slots].astype(np.int64)
            upto = np.concatenate([[0], np.cumsum(size)])
            ids = self.flat[np.arange(upto[-1]) - np.repeat(upto[:-1], size) + np.repeat(self.at[slots], size)]
            bound = upto[np.searchsorted(starts, cut)]
            odd = self.classes[code] == _ODD
            strange = odd.any()
            for i in range(b - a):
                if strange and odd[cut[i] : cut[i + 1]].any():
                    # code points that this Python's Unicode doesn't know
                    yield np.array(self.slow.encode(texts[i], add_special_tokens=False).ids, np.uint32)
                else:
                    yield ids[bound[i] : bound[i + 1]]


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
