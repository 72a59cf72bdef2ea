"""Quality by attention-based multiple-instance learning over the passages of a document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_or_empty

#: Bounds of the labelled sample: rows, and bytes of a text (longer ones are scored but not learnt from).
MAX_TRAIN, MAX_TRAIN_BYTES = 4000, 1 << 18
PASSAGE_BYTES = 512
#: Passages whose features are computed at once, and among which repeated pieces are looked for.
STRETCH_PASSAGES = 2048

#: Byte classes: lower, upper, digit, blank, line end, each mark of its own, other control, non-ASCII lead and trail.
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_class = np.full(256, 7, np.int64)
_class[97:123], _class[65:91], _class[48:58], _class[32], _class[10], _class[128:192], _class[192:] = 0, 1, 2, 3, 4, 5, 6
for _i, _c in enumerate(_MARKS):
    _class[_c] = 8 + _i
N_CLASSES = 8 + len(_MARKS)
_coarse = np.concatenate([np.arange(8), np.full(len(_MARKS), 8)])
_coarse[8 + _MARKS.index(b".")] = _coarse[8 + _MARKS.index(b",")] = 9
N_COARSE = 10
N_FEATURES = N_CLASSES + N_COARSE * N_COARSE + 3


def passages(text: str) -> np.ndarray:
    """Features of each passage of ``PASSAGE_BYTES`` bytes of the whole text: shares of byte classes and of pairs of coarse
    classes, mean word length, share of 8-byte pieces that stand earlier in the same 2048 passages too, and the passage's fill.

    Memory beside the result is that of 2048 passages, however long the text. An empty text is one empty passage.
    """
    data, step = text.encode(), STRETCH_PASSAGES * PASSAGE_BYTES
    return np.concatenate([_stretch(np.frombuffer(data[a : a + step], np.uint8)) for a in range(0, max(1, len(data)), step)])


def _stretch(data: np.ndarray) -> np.ndarray:
    n = max(1, -(-len(data) // PASSAGE_BYTES))
    out = np.zeros((n, N_FEATURES), np.float32)
    if not len(data):
        return out
    kinds = _class[data]
    at = np.arange(len(data)) // PASSAGE_BYTES
    fill = np.bincount(at, minlength=n).astype(np.float32)
    out[:, :N_CLASSES] = np.bincount(at * N_CLASSES + kinds, minlength=n * N_CLASSES).reshape(n, -1) / fill[:, None]
    coarse = _coarse[kinds]
    pair = coarse[:-1] * N_COARSE + coarse[1:]
    m = N_COARSE * N_COARSE
    out[:, N_CLASSES : N_CLASSES + m] = np.bincount(at[:-1] * m + pair, minlength=n * m).reshape(n, -1) / fill[:, None]
    out[:, -3] = fill / (fill * (out[:, 3] + out[:, 4]) + 1) / 50
    if len(data) >= 8:
        wide = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view(np.int64).ravel()
        order = np.argsort(wide, kind="stable")
        same = np.zeros(len(wide), bool)
        same[order[1:]] = wide[order[1:]] == wide[order[:-1]]
        out[:, -2] = np.bincount(at[: len(wide)], same, minlength=n) / fill
    out[:, -1] = fill / PASSAGE_BYTES
    return out


@dataclass
class AttentionModel:
    mean: np.ndarray
    scale: np.ndarray
    params: dict[str, np.ndarray]

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        x = np.concatenate(bags) if bags else np.zeros((0, N_FEATURES), np.float32)
        own = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
        return _forward(self.params, (x - self.mean) / self.scale, own, len(bags))["p"]


def _forward(q: dict, x: np.ndarray, own: np.ndarray, n: int) -> dict:
    """Encode passages, gate their attention, pool them by document and score the pooled representation."""
    h = np.tanh(x @ q["W"] + q["b"])
    t, s = np.tanh(h @ q["V"]), 1 / (1 + np.exp(-(h @ q["U"])))
    e = (t * s) @ q["w"]
    top = np.full(n, -np.inf)
    np.maximum.at(top, own, e)
    a = np.exp(e - top[own])
    a /= np.bincount(own, a, minlength=n)[own]
    z = np.zeros((n, h.shape[1]))
    np.add.at(z, own, a[:, None] * h)
    logit = z @ q["c"] + q["d"]
    return {"h": h, "t": t, "s": s, "a": a, "z": z, "p": 1 / (1 + np.exp(-np.clip(logit, -50, 50)))}


def fit(bags: list[np.ndarray], labels: list[int], hidden: int = 24, gate: int = 12, steps: int = 250, rate: float = 0.01, decay: float = 1e-3, seed: int = 3) -> AttentionModel:
    """Full-batch Adam on the document labels, classes weighted by the square root of their odds; deterministic."""
    y = np.asarray(labels, float)
    x = np.concatenate(bags) if bags else np.zeros((1, N_FEATURES), np.float32)
    own = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    mean, scale = x.mean(0), x.std(0) + 1e-3
    rng = np.random.default_rng(seed)
    q = {
        "W": rng.normal(0, 0.1, (N_FEATURES, hidden)), "b": np.zeros(hidden), "V": rng.normal(0, 0.3, (hidden, gate)), "U": rng.normal(0, 0.3, (hidden, gate)),
        "w": rng.normal(0, 0.3, gate), "c": rng.normal(0, 0.1, hidden), "d": np.zeros(1),
    }
    model = AttentionModel(mean, scale, q)
    if len(bags) == 0 or y.min() == y.max():
        q["c"][:], q["d"][:] = 0, 0 if len(bags) == 0 else (4 if y[0] else -4)
        return model
    x = (x - mean) / scale
    m, v, n = {k: np.zeros_like(a) for k, a in q.items()}, {k: np.zeros_like(a) for k, a in q.items()}, len(bags)
    rare = np.sqrt(y.mean() / (1 - y.mean()))
    weight = np.where(y == 1, 1.0, rare) / n
    for step in range(1, steps + 1):
        f = _forward(q, x, own, n)
        dl = (f["p"] - y) * weight
        g = {"c": f["z"].T @ dl, "d": dl.sum(keepdims=True)}
        dz = (dl[:, None] * q["c"])[own]
        da = (dz * f["h"]).sum(1)
        de = f["a"] * (da - np.bincount(own, f["a"] * da, minlength=n)[own])
        g["w"] = (f["t"] * f["s"]).T @ de
        dt, ds = de[:, None] * q["w"] * f["s"] * (1 - f["t"] ** 2), de[:, None] * q["w"] * f["t"] * f["s"] * (1 - f["s"])
        g["V"], g["U"] = f["h"].T @ dt, f["h"].T @ ds
        dh = (f["a"][:, None] * dz + dt @ q["V"].T + ds @ q["U"].T) * (1 - f["h"] ** 2)
        g["W"], g["b"] = x.T @ dh, dh.sum(0)
        for k in q:
            grad = g[k] + (decay * q[k] if k in "WVUc" else 0)
            m[k], v[k] = 0.9 * m[k] + 0.1 * grad, 0.999 * v[k] + 0.001 * grad**2
            q[k] = q[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    model.params = q
    return model


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def fit_on(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_bytes: int = MAX_TRAIN_BYTES, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> AttentionModel:
    """Fit on at most ``max_train`` labelled documents that are not held out, chosen by a hash of the id.

    Rows with a null id or label and texts of more than ``max_bytes`` bytes are not learnt from, so that what comes to the driver
    is bounded. Of labels that repeat an id the larger counts, of documents any one. No labels give a score of 0.5 for all.
    """
    chosen = labels.where(~held_out(id_col)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_y is not null")
    chosen = chosen.groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(max_train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [passages(t.as_py()).astype(np.float16).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary()), batch.column(2)], ["_id", "_x", "_y"])

    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")).where(F.octet_length("_text") <= max_bytes).join(F.broadcast(chosen), "_id").select("_id", "_text", "_y")
    got = sorted({r["_id"]: r for r in rows.transform(map_batches, run, "_id long, _x binary, _y int").collect()}.values(), key=lambda r: r["_id"])
    bags = [np.frombuffer(bytes(r["_x"]), np.float16).astype(np.float32).reshape(-1, N_FEATURES) for r in got]
    return fit(bags, [r["_y"] for r in got])


def score(docs: DataFrame, model: AttentionModel, id_col: str = "doc_id", text_col: str = "text", block: int = 64) -> DataFrame:
    """One row per input row: id, held_out, score, predicted. Only the whole text enters a score; null text counts as empty.

    Equal texts have equal scores but for rounding. A null id is scored like any other and counts as not held out; repeated rows
    each have their result; other columns are not looked at. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores: list[float] = []
            for i in range(0, batch.num_rows, block):
                scores.extend(model.scores([passages(t.as_py()) for t in batch.column(2).slice(i, block)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), text_or_empty(text_col).alias("text"))
    scored = base.transform(map_batches, run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
