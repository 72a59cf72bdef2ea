"""Removal of repeated long substrings with a logarithmic family of sparse suffix arrays.

Every 100-byte window has one anchor: the leftmost smallest 24-byte piece inside it. Windows of equal text have equal
anchors, so it is enough to index the suffixes that begin at anchors (about one in thirty-five); no window is lost. Suffixes
are dealt out by their anchor's piece to parts whose number grows with the input.

1. Texts are stored in compressed segments of whole documents, so that later steps move compressed bytes only.
2. Pieces that occur too often for one part's memory are avoided: a window takes another of its pieces as its anchor if it
   has one. (They are found on a sample of all occurrences; results do not depend on which are found.) The others are counted:
   a suffix whose piece occurs once in all documents can match nothing and goes no further.
3. Each part keeps a family of suffix arrays, ordered by text (:class:`SuffixFamily`). A new batch is sorted, merge-scanned
   against every level for its longest common prefixes, and put beside them; levels of like size are merged. Of suffixes
   that agree on all their windows the earliest stays, the others' windows are repeats.
4. The common prefixes to the right and to the left of the anchor tell which windows of the suffixes that are left can occur
   twice. Just those windows are sorted by text; all but the earliest of equal ones are repeats.
5. The repeated windows are united to byte ranges for each document.

All comparisons are of texts, none of hashes. Levels can be stored and given to a later call as an index of what was seen.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, release, text_or_empty, written

LENGTH, PIECE = 100, 24
REACH = LENGTH - PIECE + 1
LEFT = REACH - 1
#: Bytes of a stored suffix: text from the anchor on, text before it backwards, first and last offset of its windows.
STORED = LENGTH + LEFT + 2
#: Segments hold at least so many bytes or documents; longer documents are segments of their own.
SEGMENT, SEGMENT_DOCS = 1 << 20, 8192
#: Bytes whose anchors are found at once.
STRETCH = 1 << 20
#: Text bytes whose suffixes make up one part, if each is distinct: about 50 MB of memory.
PART_BYTES = 1 << 23
#: Suffixes of a batch, the smallest level of a family.
BATCH = 1 << 14
#: A piece that occurs more often than this, and than a millionth of all, is avoided as an anchor.
HOT = 1 << 17
#: One in so many occurrences is counted to find such pieces.
HOT_SAMPLE = 64
#: Windows that are sorted at once, and marks that are held before they are passed on.
WINDOWS, MARKS = 1 << 17, 1 << 17
_OLD = np.iinfo(np.int64).min

_rng = np.random.default_rng(77)
_BYTES = _rng.integers(0, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FIN = np.uint64(0xBF58476D1CE4E5B9)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_INDEX = np.uint64((1 << 24) - 1)
_NO_KEYS = np.zeros(0, np.uint64)
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    got = _powers.get(int(base))
    if got is None or len(got) < n:
        got = np.full(max(n, 1 << 16), base, np.uint64)
        got[0] = 1
        got = np.multiply.accumulate(got)
        _powers[int(base)] = got
    return got[:n]


def piece_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each run of ``PIECE`` bytes, from prefix sums modulo 2**64."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.take(_BYTES, data, out=sums[1:])
    sums[1:] *= _power(_BASE, n)
    np.cumsum(sums[1:], out=sums[1:])
    out = sums[PIECE:] - sums[:-PIECE]
    out *= _power(_INVERSE, n - PIECE + 1)
    out ^= out >> np.uint64(32)
    out *= _FIN
    return out


def anchors(data: np.ndarray, ends: np.ndarray, hot: np.ndarray = _NO_KEYS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, first window, last window, hash) of each anchor of the windows that lie within one of the documents,
    which end at ``ends``. Pieces in ``hot`` come after all others. ``data`` has at most 2**24 bytes."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, _NO_KEYS
    hashes = piece_hashes(data)
    low = hashes >> np.uint64(1)
    low &= ~_INDEX
    low |= np.arange(len(hashes), dtype=np.uint64)
    if len(hot):
        low[hot[np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)] == hashes] |= np.uint64(1 << 63)
    width = 1
    while width * 2 <= REACH:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = REACH - width
    low = np.minimum(low[: len(low) - rest], low[rest:])
    at = (low & _INDEX).astype(np.int64)
    ok = np.ones(len(at), bool)
    for e in ends[:-1]:
        ok[max(0, e - LENGTH + 1) : e] = False
    starts = np.flatnonzero(ok)
    if not len(starts):
        return none, none, none, _NO_KEYS
    at = at[starts]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(at)]]) - 1
    return at[first], starts[first], starts[last], hashes[at[first]]


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys * _BASE >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


@dataclass
class Suffixes:
    """Suffixes with their order of occurrence (id, tie, ref, pos) and the longest common prefix met so far.

    ``text`` holds, for each, the text from the anchor on as far as its windows reach, the text before it backwards, and the
    first and last offset of its windows from the anchor. ``ref`` says where the document is; stored ones have none (-1).
    """

    text: np.ndarray
    id: np.ndarray
    tie: np.ndarray
    ref: np.ndarray
    pos: np.ndarray
    like: np.ndarray

    def __len__(self) -> int:
        return len(self.text)

    def take(self, i: np.ndarray) -> Suffixes:
        return Suffixes(*(getattr(self, k)[i] for k in self.__dataclass_fields__))

    @staticmethod
    def concat(all_: list[Suffixes]) -> Suffixes:
        return Suffixes(*(np.concatenate([getattr(s, k) for s in all_]) for k in Suffixes.__dataclass_fields__))

    def bytes(self) -> np.ndarray:
        return self.text.view(np.uint8).reshape(len(self), STORED)

    def in_order(self) -> np.ndarray:
        return np.lexsort((self.pos, self.ref, self.tie, self.id))

    def marks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ref, first window, last window) of all windows of the suffixes."""
        own = self.bytes()
        return self.ref, self.pos - own[:, -1], self.pos - own[:, -2]


def stored_text(data: np.ndarray, pos: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The stored texts of the anchors of ``data``; beyond their windows they are zero."""
    padded = np.concatenate([np.zeros(LEFT, np.uint8), data, np.zeros(LENGTH, np.uint8)])
    around = np.lib.stride_tricks.sliding_window_view(padded, LEFT + LENGTH)[pos]
    out = np.empty((len(pos), STORED), np.uint8)
    out[:, :LENGTH], out[:, LENGTH:-2] = around[:, LEFT:], around[:, LEFT - 1 :: -1]
    first, last = (pos - hi).astype(np.uint8), (pos - lo).astype(np.uint8)
    out[:, :LENGTH][np.arange(LENGTH)[None] >= LENGTH - first[:, None].astype(np.int64)] = 0
    out[:, LENGTH:-2][np.arange(LEFT)[None] >= last[:, None]] = 0
    out[:, -2], out[:, -1] = first, last
    return out.reshape(-1).view(f"S{STORED}")


def _prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of stored suffixes, as far as the windows of both reach."""
    same = a[:, :LENGTH] == b[:, :LENGTH]
    n = np.where(same.all(1), LENGTH, same.argmin(1))
    return np.minimum(n, LENGTH - np.maximum(a[:, -2], b[:, -2]).astype(np.int64)).astype(np.uint8)


def _earlier(a: Suffixes, b: Suffixes) -> np.ndarray:
    """Does each of ``a`` occur before its counterpart in ``b``?"""
    out = a.pos < b.pos
    for k in ("ref", "tie", "id"):
        x, y = getattr(a, k), getattr(b, k)
        out = (x < y) | ((x == y) & out)
    return out


def in_text_order(new: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """Places of the suffixes sorted by text, the earliest of equal ones only; and of the others."""
    order = new.in_order()
    order = order[np.argsort(new.text[order], kind="stable")]
    text = new.text[order]
    first = np.ones(len(new), bool)
    first[1:] = text[1:] != text[:-1]
    return order[first], order[~first]


def suffix_array(new: Suffixes) -> tuple[Suffixes, Suffixes]:
    """The suffixes sorted by text, the earliest of equal ones only, with their neighbours' common prefixes; and the others."""
    out, rest = map(new.take, in_text_order(new))
    if len(out) > 1:
        own = out.bytes()
        n = _prefix(own[1:], own[:-1])
        out.like[1:] = np.maximum(out.like[1:], n)
        out.like[:-1] = np.maximum(out.like[:-1], n)
    return out, rest


class SuffixFamily:
    """Levels of suffix arrays without equal suffixes; :meth:`add` gives back the suffixes that turned out to be repeats."""

    def __init__(self):
        self.levels: list[Suffixes] = []

    @staticmethod
    def _scan(batch: Suffixes, level: Suffixes) -> tuple[Suffixes, Suffixes]:
        """Merge-scan: where each suffix of the batch would stand in the level, and what it shares with both neighbours there.

        A suffix of the level learns its common prefix from the neighbours too: with any other of the batch it shares no more
        than with its own neighbour in the level, which it has met. Of equal suffixes the earlier one takes the level's place.
        """
        at = np.searchsorted(level.text, batch.text)
        equal = np.zeros(len(batch), bool)
        inside = at < len(level)
        equal[inside] = level.text[at[inside]] == batch.text[inside]
        own, there = batch.bytes(), level.bytes()
        for beside in (at - 1, at):
            ok = np.flatnonzero((beside >= 0) & (beside < len(level)) & ~equal)
            n = _prefix(own[ok], there[beside[ok]])
            batch.like[ok] = np.maximum(batch.like[ok], n)
            np.maximum.at(level.like, beside[ok], n)
        i, j = np.flatnonzero(equal), at[equal]
        repeats, held = batch.take(i), level.take(j)
        before = _earlier(repeats, held)
        for k in ("id", "tie", "ref", "pos"):
            getattr(level, k)[j[before]] = getattr(repeats, k)[before]
        gone = Suffixes.concat([held.take(before), repeats.take(~before)])
        return batch.take(~equal), gone

    @staticmethod
    def merged(a: Suffixes, b: Suffixes) -> Suffixes:
        """Two levels as one; they have no suffix in common."""
        at = np.searchsorted(a.text, b.text) + np.arange(len(b))
        rest = np.ones(len(a) + len(b), bool)
        rest[at] = False
        out = []
        for k in Suffixes.__dataclass_fields__:
            x = np.empty(len(rest), getattr(a, k).dtype)
            x[at], x[rest] = getattr(b, k), getattr(a, k)
            out.append(x)
        return Suffixes(*out)

    def add(self, new: Suffixes) -> Suffixes:
        """Scan a new batch against all levels and make it a level; merge while the last is at least half the one before."""
        batch, repeats = suffix_array(new)
        gone = [repeats]
        for level in self.levels:
            batch, more = self._scan(batch, level)
            gone.append(more)
        if len(batch):
            self.levels.append(batch)
        while len(self.levels) > 1 and 2 * len(self.levels[-1]) >= len(self.levels[-2]):
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(self.merged(a, b))
        return Suffixes.concat(gone)

    def whole(self) -> Suffixes | None:
        """All levels as one."""
        while len(self.levels) > 1:
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(self.merged(a, b))
        return self.levels[0] if self.levels else None


def repeated_windows(level: Suffixes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ref, start) of the windows, of distinct suffixes, whose text is another suffix's window too and occurs there earlier.

    A window that begins i bytes before the anchor can only be met again if the suffix shares its last 100 - i bytes with
    another one's to the right of the anchor, and the i bytes to the left with some other of the same piece.
    """
    level = level.take(level.like >= PIECE)
    if len(level) < 2:
        return
    own = level.bytes()
    piece = np.zeros(len(level), np.int64)
    piece[1:] = np.cumsum((own[1:, :PIECE] != own[:-1, :PIECE]).any(1))
    backwards = np.ascontiguousarray(own[:, LENGTH:-2])
    order = np.lexsort((backwards.view(f"S{LEFT}").ravel(), piece))
    a, b = order[1:], order[:-1]
    same = backwards[a] == backwards[b]
    n = np.where(same.all(1), LEFT, same.argmin(1))
    n = np.where(piece[a] == piece[b], np.minimum(n, np.minimum(own[a, -1], own[b, -1])), 0)
    left = np.zeros(len(level), np.int64)
    np.maximum.at(left, a, n)
    np.maximum.at(left, b, n)
    lo = np.maximum(own[:, -2].astype(np.int64), LENGTH - level.like.astype(np.int64))
    many = np.minimum(left, own[:, -1]) - lo + 1
    open_ = np.flatnonzero(many > 0)
    open_ = open_[level.take(open_).in_order()]
    open_ = open_[np.argsort(piece[open_], kind="stable")]
    ends = np.cumsum(many[open_])
    cuts = [0]
    borders = np.flatnonzero(np.concatenate([piece[open_][1:] != piece[open_][:-1], [True]])) + 1 if len(open_) else []
    done = 0
    for i, e in enumerate(borders):
        following = ends[borders[i + 1] - 1] if i + 1 < len(borders) else None
        if following is None or following - done > WINDOWS:
            cuts.append(int(e))
            done = int(ends[e - 1])
    for c, d in zip(cuts[:-1], cuts[1:], strict=True):
        rows = open_[c:d]
        if many[rows].sum() <= WINDOWS:
            which = np.repeat(rows, many[rows])
            offset = lo[which] + np.arange(len(which)) - np.repeat(np.cumsum(many[rows]) - many[rows], many[rows])
            yield _later(level, own, which, offset)
        else:  # one piece in very many texts: equal windows have equal offsets
            for i in range(LEFT + 1):
                which = rows[(lo[rows] <= i) & (i < lo[rows] + many[rows])]
                if len(which) > 1:
                    yield _later(level, own, which, np.full(len(which), i))


def _later(level: Suffixes, own: np.ndarray, which: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of windows, in order of occurrence, those that have an equal one before them."""
    around = np.concatenate([own[which, LENGTH:-2][:, ::-1], own[which, :LENGTH]], 1)
    texts = np.lib.stride_tricks.sliding_window_view(around, LENGTH, axis=1)[np.arange(len(which)), LEFT - offset]
    texts = np.ascontiguousarray(texts).view(f"S{LENGTH}").ravel()
    order = np.argsort(texts, kind="stable")
    again = order[1:][texts[order[1:]] == texts[order[:-1]]]
    return level.ref[which[again]], level.pos[which[again]] - offset[again]


def _merged(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows lo..hi of a document, joined where they touch or overlap."""
    if not len(doc):
        return doc, lo, hi
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    base = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]])) * (1 << 40)
    reach = np.maximum.accumulate(hi + base)
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (lo[1:] + base[1:] > reach[:-1] + 1)])
    start = np.flatnonzero(new)
    return doc[start], lo[start], np.maximum.reduceat(hi, start)


def _packed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> bytes:
    return pa.decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds.values(), strict=True)], list(kinds))


_SEGMENT = {"seg": pa.int64(), "ids": pa.binary(), "ties": pa.binary(), "unnamed": pa.binary(), "ends": pa.binary(), "text": pa.binary(), "size": pa.int64()}
_SEGMENT_SQL = "seg long, ids binary, ties binary, unnamed binary, ends binary, text binary, size long"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole documents (_key, _tie, _unnamed, _data) in compressed segments of at least ``SEGMENT`` bytes, but for the last."""
    from pyspark import TaskContext

    part, made, held, size = TaskContext.get().partitionId(), 0, [], 0

    def flush() -> pa.RecordBatch:
        nonlocal made, held, size
        keys, ties, unnamed, texts = zip(*held, strict=True)
        row = ((part << 32) + made, np.array(keys, np.int64).tobytes(), np.array(ties, np.int64).tobytes(), np.array(unnamed, np.uint8).tobytes(), np.cumsum([len(t) for t in texts], dtype=np.int64).tobytes(), _packed(b"".join(texts)), size)
        made, held, size = made + 1, [], 0
        return _batch([row], _SEGMENT)

    for batch in batches:
        for key, tie, unnamed, text in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
            data = text.as_py()
            if held and size + len(data) > 2 * SEGMENT:
                yield flush()
            held.append((key, tie, unnamed, data))
            size += len(data)
            if size >= SEGMENT or len(held) == SEGMENT_DOCS:
                yield flush()
    if held:
        yield flush()


def _stretches(text: bytes, ends: np.ndarray, hot: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(data, position, first window, last window, hash), positions within data and its offset in the segment, by stretches."""
    whole = np.frombuffer(text, np.uint8)
    for a in range(0, max(1, len(whole) - LENGTH + 1), STRETCH):
        data = whole[a : a + STRETCH + LENGTH - 1]
        inner = ends[(ends > a) & (ends < a + len(data))] - a
        yield a, data, *anchors(data, np.concatenate([inner, [len(data)]]), hot)


def _is_hot(keys: np.ndarray, hot: np.ndarray) -> np.ndarray:
    return hot[np.minimum(np.searchsorted(hot, keys), len(hot) - 1)] == keys if len(hot) else np.zeros(len(keys), bool)


def _sampled_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the pieces of anchors, each once a stretch, one in ``HOT_SAMPLE`` of these occurrences."""
    for batch in batches:
        for seg, ends, text in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            for a, *_, keys in _stretches(_unpacked(text.as_py()), np.frombuffer(ends.as_py(), np.int64), _NO_KEYS):
                keys = np.unique(keys)
                drawn = ((keys ^ np.uint64(xxhash.xxh3_64_intdigest(f"{seg} {a}"))) * _FIN >> np.uint64(32)) % np.uint64(HOT_SAMPLE) == 0
                yield pa.RecordBatch.from_arrays([pa.array(keys[drawn].view(np.int64))], ["key"])


_KEYS = {"part": pa.int32(), "seg": pa.int64(), "stretch": pa.int32(), "keys": pa.binary()}
_KEYS_SQL = "part int, seg long, stretch int, keys binary"


def _key_blocks(parts: int, hot: np.ndarray):
    """For each segment's stretch and each part the hashes of its anchors' pieces, in order, but for those known as hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seg, ends, text in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                for k, (*_, keys) in enumerate(_stretches(_unpacked(text.as_py()), np.frombuffer(ends.as_py(), np.int64), hot)):
                    keys = keys[~_is_hot(keys, hot)]
                    part = _part_of(keys, parts)
                    order = np.argsort(part, kind="stable")
                    present, begin = np.unique(part[order], return_index=True)
                    end = np.append(begin[1:], len(order))
                    yield _batch([(p, seg, k, keys[order[i:j]].tobytes()) for p, i, j in zip(present.tolist(), begin.tolist(), end.tolist(), strict=True)], _KEYS)

    return run


_SHARED = {"seg": pa.int64(), "stretch": pa.int32(), "part": pa.int32(), "bits": pa.binary()}
_SHARED_SQL = "seg long, stretch int, part int, bits binary"


def _shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block a bit for each key: does it occur more than once? A part's keys are held at once, eight bytes each."""
    held: dict[int, list[tuple[int, int, bytes]]] = {}
    for batch in batches:
        for part, *block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.setdefault(part, []).append(block)
    for part, blocks in held.items():
        _, inverse, counts = np.unique(np.concatenate([np.frombuffer(b[2], np.uint64) for b in blocks]), return_inverse=True, return_counts=True)
        shared, at, rows = counts[inverse] > 1, 0, []
        for seg, stretch, own in blocks:
            n = len(own) // 8
            rows.append((seg, stretch, part, np.packbits(shared[at : at + n]).tobytes()))
            at += n
        yield _batch(rows, _SHARED)


_BLOCK = {"part": pa.int32(), "payload": pa.binary()}
_BLOCK_SQL = "part int, payload binary"


def _payload(own: Suffixes) -> bytes:
    keys, back = np.unique(own.ref, return_inverse=True)
    one = np.zeros(len(keys), np.int64)
    one[back] = np.arange(len(own))
    head = np.array([len(own), len(keys)], np.int64)
    return _packed(b"".join(x.tobytes() for x in (head, keys, own.id[one], own.tie[one], back.astype("<u4"), own.pos, own.text)))


def _suffixes(payload: bytes) -> Suffixes:
    data = _unpacked(payload)
    n, m = np.frombuffer(data, np.int64, 2)
    keys, ids, ties = (np.frombuffer(data, np.int64, m, 16 + 8 * m * k) for k in range(3))
    at = 16 + 24 * m
    back = np.frombuffer(data, "<u4", n, at)
    pos = np.frombuffer(data, np.int64, n, at + 4 * n)
    text = np.frombuffer(data, f"S{STORED}", n, at + 12 * n)
    return Suffixes(text, ids[back], ties[back], keys[back], pos, np.zeros(n, np.uint8))


def _suffix_blocks(parts: int, hot: np.ndarray, pruned: bool):
    """For each segment's stretch and each part its suffixes in text order; of equal ones of a stretch only the earliest, the
    others as marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seg, ids, ties, ends, text, flags in zip(*(batch.column(i).to_pylist() for i in range(5)), batch.column(5).to_pylist() if pruned else [None] * batch.num_rows, strict=True):
                ids, ties, ends = (np.frombuffer(x, np.int64) for x in (ids, ties, ends))
                bits: dict[tuple[int, int], bytes] = {(f["stretch"], f["part"]): f["bits"] for f in flags or ()}
                for k, (a, data, pos, lo, hi, keys) in enumerate(_stretches(_unpacked(text), ends, hot)):
                    part = _part_of(keys, parts)
                    wanted = np.ones(len(part), bool)
                    if pruned:
                        cold = np.flatnonzero(~_is_hot(keys, hot))
                        cold = cold[np.argsort(part[cold], kind="stable")]
                        present, begins = np.unique(part[cold], return_index=True)
                        for p, i in zip(present.tolist(), np.split(cold, begins[1:]), strict=True):
                            wanted[i] = np.unpackbits(np.frombuffer(bits[k, p], np.uint8), count=len(i)).astype(bool)
                    i = np.flatnonzero(wanted)
                    if not len(i):
                        continue
                    own = np.searchsorted(ends, pos[i] + a, "right")
                    begin = np.where(own > 0, ends[own - 1], 0)
                    new = Suffixes(stored_text(data, pos[i], lo[i], hi[i]), ids[own], ties[own], (seg << 20) + own, pos[i] + a - begin, np.zeros(len(i), np.uint8))
                    kept, again = in_text_order(new)
                    part = part[i][kept]
                    kept = kept[np.argsort(part, kind="stable")]
                    present, begins = np.unique(part, return_counts=True)
                    rows = [(p, _payload(new.take(j)), None) for p, j in zip(present.tolist(), np.split(kept, np.cumsum(begins)[:-1]), strict=True)]
                    if len(again):
                        rows[0] = (*rows[0][:2], _marks_payload(*new.take(again).marks()))
                    yield _batch(rows, _BLOCK | {"marks": pa.binary()})

    return run


def _marks_payload(ref: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> bytes:
    return b"".join(x.astype(np.int64).tobytes() for x in _merged(ref, lo, hi))


_MARKS = {"seg": pa.int64(), "marks": pa.binary(), "part": pa.int32(), "payload": pa.binary()}
_MARKS_SQL = "seg long, marks binary, part int, payload binary"


def _judge(keep: bool):
    """The family of each part: marks (document within the segment, first and last window) by segment, and, if to be kept,
    the part's levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        families: dict[int, SuffixFamily] = {}
        waiting: dict[int, list[Suffixes]] = {}
        marks: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def told() -> pa.RecordBatch:
            ref, lo, hi = map(np.concatenate, zip(*marks, strict=True))
            marks.clear()
            new = ref >= 0
            ref, lo, hi = _merged(ref[new], lo[new], hi[new])
            cuts = np.flatnonzero(np.concatenate([[True], ref[1:] >> 20 != ref[:-1] >> 20, [True]])) if len(ref) else []
            rows = [(int(ref[a]) >> 20, np.stack([ref[a:b] & ((1 << 20) - 1), lo[a:b], hi[a:b]]).tobytes(), None, None) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            return _batch(rows, _MARKS)

        def add(part: int) -> None:
            marks.append(families.setdefault(part, SuffixFamily()).add(Suffixes.concat(waiting.pop(part))).marks())

        for batch in batches:
            for part, payload, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if found is not None:
                    marks.append(tuple(np.frombuffer(found, np.int64).reshape(3, -1)))
                held = waiting.setdefault(part, [])
                held.append(_suffixes(payload))
                if sum(map(len, held)) >= BATCH:
                    add(part)
                if sum(len(m[0]) for m in marks) >= MARKS:
                    yield told()
        for part in list(waiting):
            add(part)
        for part, family in families.items():
            level = family.whole()
            if level is None:
                continue
            for ref, start in repeated_windows(level):
                marks.append((ref, start, start))
                if sum(len(m[0]) for m in marks) >= MARKS:
                    yield told()
            if keep:
                n = len(level)
                old = Suffixes(level.text, np.full(n, _OLD), np.full(n, _OLD), np.full(n, -1), np.full(n, -1), level.like)
                yield _batch([(None, None, part, _payload(old.take(slice(i, i + BATCH)))) for i in range(0, n, BATCH)], _MARKS)
        if marks:
            yield told()

    return run


_RESULT = {"id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "spans": pa.list_(pa.list_(pa.int64())), "kept": pa.binary()}
_RESULT_SQL = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<bigint>>, kept binary"


def _cut(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, unnamed, ends, text, found = (batch.column(c)[i].as_py() for c in ("ids", "unnamed", "ends", "text", "_marks"))
                ids, unnamed, ends, text = np.frombuffer(ids, np.int64).tolist(), unnamed, np.frombuffer(ends, np.int64).tolist(), memoryview(_unpacked(text))
                marks = np.concatenate([np.zeros((3, 0), np.int64), *(np.frombuffer(m, np.int64).reshape(3, -1) for m in found or ())], 1)
                # windows of neighbouring starts, and ranges that touch, are one range
                at, lo, hi = _merged(marks[0], marks[1], marks[2] + LENGTH - 1)
                cuts = np.searchsorted(at, np.arange(len(ids) + 1))
                rows, begin = [], 0
                for d, (key, end) in enumerate(zip(ids, ends, strict=True)):
                    data = text[begin:end]
                    spans = [[a, b + 1] for a, b in zip(lo[cuts[d] : cuts[d + 1]].tolist(), hi[cuts[d] : cuts[d + 1]].tolist(), strict=True)]
                    kept, last = [], 0
                    for a, b in spans:
                        kept.append(data[last:a])
                        last = b
                    left = b"".join([*kept, data[last:]])
                    rows.append((None if unnamed[d] else key, len(data), len(data) - len(left), len(spans), hashlib.sha256(left).hexdigest(), spans, left if keep_text else None))
                    begin = end
                yield _batch(rows, _RESULT)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, index: str | None = None, store: str | None = None) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed byte ranges), kept (bytes, if asked for).

    A byte goes when a 100-byte string of the input that covers it also starts earlier: in a document with a smaller id, or
    before in the same document. ``store`` is a path to write the family of suffix arrays to; a later call that is given
    it as ``index`` takes all texts of the earlier call as occurring before its own. With either, no suffix is left out for
    having a piece that occurs once, since later documents may have it too.

    Null text counts as empty; an empty table gives no rows. Rows that repeat an id are documents of their own, ordered by a
    hash of their texts, and those equal in both in any order, so that one of them stays whole. Null ids come after all others,
    ordered likewise. Other columns are not looked at, whatever their names. A document has to fit in memory.
    """
    spark = docs.sparkSession
    text, unnamed = text_or_empty(text_col), F.col(id_col).isNull()
    base = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("_key"), F.xxhash64(text, F.when(unnamed, F.lit(1)).otherwise(F.lit(0))).alias("_tie"), unnamed.alias("_unnamed"), F.encode(text, "UTF-8").alias("_data")
    )
    segments = written(base.transform(map_batches, _segments, _SEGMENT_SQL), "repeat-segments")
    lists = lambda df, value: df.groupBy("seg").agg(F.collect_list(value).alias("_list")).withColumnRenamed("seg", "_seg")

    flags = None
    if index is None:
        size = segments.agg(F.sum("size")).first()[0] or 0
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
        most = max(HOT, size // 35_000_000)
        often = segments.select("seg", "ends", "text").transform(map_batches, _sampled_keys, "key long").groupBy("key").count().where(F.col("count") * HOT_SAMPLE > most)
        hot = np.sort(np.array([r["key"] for r in often.select("key").collect()], np.int64).view(np.uint64))  # about a million at most
        source = segments.select("seg", "ids", "ties", "ends", "text")
        if store is None:
            keys = segments.select("seg", "ends", "text").transform(map_batches, _key_blocks(parts, hot), _KEYS_SQL)
            flags = written(keys.repartitionById(parts, F.col("part")).transform(map_batches, _shared_keys, _SHARED_SQL), "repeat-shared")
            source = source.join(lists(flags, F.struct("stretch", "part", "bits")), F.col("seg") == F.col("_seg"), "left").select("seg", "ids", "ties", "ends", "text", "_list")
        blocks = source.transform(map_batches, _suffix_blocks(parts, hot, store is None), f"{_BLOCK_SQL}, marks binary")
    else:
        known = spark.read.schema("part int, payload binary, parts int, hot binary").parquet(index)
        head = known.where("part is null").first()
        parts, hot = head["parts"], np.frombuffer(head["hot"], np.uint64)
        blocks = segments.select("seg", "ids", "ties", "ends", "text").transform(map_batches, _suffix_blocks(parts, hot, False), f"{_BLOCK_SQL}, marks binary")
        blocks = blocks.unionByName(known.where("part is not null").select("part", "payload", F.lit(None).cast("binary").alias("marks")))
    judged = written(blocks.repartitionById(parts, F.col("part")).transform(map_batches, _judge(store is not None), _MARKS_SQL), "repeat-marks")
    if store is not None:
        meta = spark.createDataFrame([(None, None, parts, bytearray(hot.tobytes()))], "part int, payload binary, parts int, hot binary")
        levels = judged.where("seg is null").select("part", "payload", F.lit(None).cast("int").alias("parts"), F.lit(None).cast("binary").alias("hot"))
        levels.unionByName(meta).write.parquet(store)
    if flags is not None:
        release(flags)
    own = lists(judged.where("seg is not null"), F.col("marks"))
    out = segments.join(own, F.col("seg") == F.col("_seg"), "left").withColumnRenamed("_list", "_marks").drop("seg", "_seg", "ties").transform(map_batches, _cut(keep_text), _RESULT_SQL)
    return out.withColumnRenamed("id", id_col).select(id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", *(["kept"] if keep_text else []))
