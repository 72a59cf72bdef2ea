"""Sequence packing with a bounded number of open windows."""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_or_empty, written

WINDOW = 2048
OPEN_WINDOWS = 64
END_ID = 1
#: Partitions whose leftover windows are merged together.
MERGE_FAN_IN = 64


class BpeIds:
    """Ids of the byte-level BPE, as its ``tokenizers`` file gives them without special tokens added.

    Cuts at single blanks are cuts of the pre-tokenizer too, so ids of blank-led chunks are kept in a bounded table;
    texts with runs of blanks, a blank at the end or a special token's string go through a whole-text path.
    """

    def __init__(self, json_path: str, most_kept: int = 400_000, longest_kept: int = 48):
        import json

        self.json_path, self._exact = json_path, None
        self.most_kept, self.longest_kept, self.kept = most_kept, longest_kept, {}
        with open(json_path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.fast = self._same_vocabulary(json_path)

    @property
    def exact(self):
        """The file's own tokenizer, loaded when a text first asks for it, since it takes as much memory as all else here."""
        if self._exact is None:
            from tokenizers import Tokenizer

            self._exact = Tokenizer.from_file(self.json_path)
        return self._exact

    def _same_vocabulary(self, json_path: str):
        """The same vocabulary as ranks, if its file lies beside: several times faster, ids equal (tested)."""
        import os

        import public_tokenizers
        import tiktoken

        ranks_path = os.path.splitext(json_path)[0] + ".tiktoken"
        if not os.path.exists(ranks_path):
            return None
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> bytes:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()

    def chunk(self, chunk: str) -> bytes:
        ids = self.whole(" " + chunk)
        if len(chunk) <= self.longest_kept:
            if len(self.kept) >= self.most_kept:
                self.kept.clear()
            self.kept[chunk] = ids
        return ids

    def __call__(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        if "  " in text or text[-1] == " " or any(s in text for s in self.special):
            return np.frombuffer(self.whole(text), "<u4")
        first, *rest = text.split(" ")
        get, out = self.kept.get, [self.whole(first)] if first else []
        for ids, c in zip(map(get, rest), rest, strict=True):
            out.append(self.chunk(c) if ids is None else ids)
        return np.frombuffer(b"".join(out), "<u4")


def filled(pieces: Iterable[tuple], window: int) -> Iterator[list]:
    """The pieces (tag, start, ids) one after the other in full windows, cut at their borders; only the last may have room."""
    room, own = window, []
    for tag, start, ids in pieces:
        while len(ids):
            own.append((tag, start, ids[:room]))
            ids, start, room = ids[room:], start + room, room - min(room, len(ids))
            if room == 0:
                yield own
                room, own = window, []
    if own:
        yield own


class Packer:
    """A fixed number of open windows of pieces; gives closed windows as lists of (tag, start, ids)."""

    def __init__(self, window: int = WINDOW, open_windows: int = OPEN_WINDOWS):
        self.window, self.most = window, open_windows
        self.rooms: list[int] = []  # ascending; open[i] has rooms[i] left
        self.open: list[list] = []

    def add(self, tag, ids: np.ndarray) -> Iterator[list]:
        """Cut full windows from a longer document; place the rest best-fit; if no open window has room, emit the fullest one
        as it is and open another."""
        start = 0
        while len(ids) - start >= self.window:
            yield [(tag, start, ids[start : start + self.window])]
            start += self.window
        n = len(ids) - start
        if n == 0:
            return
        i = bisect_left(self.rooms, n)
        if i < len(self.rooms):
            room, pieces = self.rooms.pop(i) - n, self.open.pop(i)
        else:
            if len(self.open) >= self.most:
                self.rooms.pop(0)
                yield self.open.pop(0)
            room, pieces = self.window - n, []
        pieces.append((tag, start, ids[start:]))
        if room == 0:
            yield pieces
        else:
            i = bisect_left(self.rooms, room)
            self.rooms.insert(i, room)
            self.open.insert(i, pieces)

    def merge(self) -> Iterator[list]:
        """Merge what is open into full windows; at most one window stays open."""
        rest = [p for pieces in self.open for p in pieces]
        self.rooms, self.open = [], []
        for pieces in filled(rest, self.window):
            n = sum(len(ids) for *_, ids in pieces)
            if n == self.window:
                yield pieces
            else:
                self.rooms, self.open = [self.window - n], [pieces]


_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long, ids binary"


def _rows(sequence: int, part: int, pieces: list, keep_ids: bool) -> Iterator[tuple]:
    offset = 0
    for (doc, n), start, ids in pieces:
        raw = ids.tobytes()
        yield (doc, start, len(ids), zlib.crc32(raw), n, sequence, offset, part, raw if keep_ids else None)
        offset += len(ids)


def _frame(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in _SCHEMA.split(", ")]
    kinds = [pa.int64()] * 8 + [pa.binary()]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 9
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
    keep_ids: bool = False,
    make_ids: Callable[[str], Callable[[str], np.ndarray]] = BpeIds,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids if ``keep_ids``).

    Each partition keeps ``open_windows`` windows open, places a document best-fit, and when none fits emits the fullest
    window, which is padded, and opens another. Documents of a window's length and more are cut into full windows and a rest. At
    its end a partition merges its open windows, cutting what stands at a border; the one left over is merged with those of
    ``MERGE_FAN_IN`` neighbouring partitions, so that no task ever gathers the leftovers of all. Memory is the open windows and
    one batch of documents.

    Null text is empty: one piece holding only the end id. A null id stays null. Rows that repeat an id are packed each
    on their own. An empty table gives no rows.
    """
    end = np.array([END_ID], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode, packer, made, rows = make_ids(tokenizer_path), Packer(window, open_windows), 0, []

        def emit(closed: Iterator[list]) -> None:
            nonlocal made
            for pieces in closed:
                rows.extend(_rows((part << 32) + made, part, pieces, keep_ids))
                made += 1

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate([encode(text.as_py()), end])
                emit(packer.add((doc, len(ids)), ids))
            if len(rows) >= 5000:
                yield _frame(rows)
                rows = []
        emit(packer.merge())
        for pieces in packer.open:
            rows.extend(_rows(-1, part, pieces, True))
        if rows:
            yield _frame(rows)

    def merge_left(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "offset"])
        group, rows = int(pdf["part"].iloc[0]) // MERGE_FAN_IN, []
        ids_of = pdf["doc_id"].astype(object).where(pdf["doc_id"].notna(), None)
        left = (((None if doc is None else int(doc), int(n)), int(start), np.frombuffer(raw, "<u4")) for doc, n, start, raw in zip(ids_of, pdf["doc_tokens"], pdf["start"], pdf["ids"], strict=True))
        for made, pieces in enumerate(filled(left, window)):
            rows.extend(_rows((1 << 62) + (group << 32) + made, group, pieces, keep_ids))
        return _frame(rows).to_pandas()

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    pieces = written(base.transform(map_batches, run, _SCHEMA), "pack-pieces")
    left = pieces.where("sequence_id = -1").groupBy((F.col("part") / MERGE_FAN_IN).cast("long").alias("_group")).applyInPandas(merge_left, _SCHEMA)
    out = pieces.where("sequence_id <> -1").unionByName(left).drop("part")
    return out if keep_ids else out.drop("ids")
