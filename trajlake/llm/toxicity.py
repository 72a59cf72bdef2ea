"""Toxicity by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_or_empty

#: Bounds of the labelled sample: rows, and bytes of a text (longer ones are judged but not learnt from).
MAX_TRAIN, MAX_TRAIN_BYTES = 3000, 1 << 18
#: A document is rejected from this probability of a grade above 0 on.
THRESHOLD = 0.4
#: A feature counts if so many labelled texts of the sample have it; rarer ones would fit single texts.
MIN_TEXTS = 5

_table = bytearray(b" " * 256)
for _c in b"abcdefghijklmnopqrstuvwxyz":
    _table[_c] = _c
    _table[_c - 32] = _c
for _c in range(128, 256):
    _table[_c] = _c
WORDS_TABLE = bytes(_table)


def words_of(text: str) -> list[bytes]:
    """Runs of letters and non-ASCII characters, A-Z lower-cased."""
    return text.encode().translate(WORDS_TABLE).split()


#: Byte lengths of the word beginnings that are features beside the whole words.
PREFIXES = (6, 7, 8, 9)


def features_of(word: bytes) -> list[bytes]:
    """The word and, marked by a trailing *, its beginnings."""
    return [word, *(word[:k] + b"*" for k in PREFIXES if len(word) > k)]


#: A text is judged by its worst run of so many words; runs begin at every half of that, so that none is cut at a border only.
WINDOW = 64


def windows_of(n_words: int) -> list[tuple[int, int]]:
    """Beginnings and ends of the overlapping runs that cover a text; one run, perhaps empty, for a short text."""
    half = WINDOW // 2
    return [(at, min(at + WINDOW, n_words)) for at in range(0, max(1, n_words - half), half)]


@dataclass
class Ordinal:
    """P(grade > k) = sigmoid(w.x - cut_k): one weight for each feature, shared by all ordered cuts."""

    weights: dict[bytes, float]
    cuts: np.ndarray

    def __post_init__(self):
        self._words: dict[bytes, float] = {}

    def _weigh(self, word: bytes) -> float:
        total = sum(self.weights.get(f, 0.0) for f in features_of(word))
        if len(self._words) >= 1 << 17:
            self._words.clear()
        if len(word) <= 48:
            self._words[word] = total
        return total

    def margin(self, text: str) -> float:
        """The largest over the text's windows of the sum of weight times square root of occurrences of the window's words."""
        words = words_of(text)
        get, at, heavy = self._words.get, [], []
        for i, word in enumerate(words):
            got = get(word)
            if got is None:
                got = self._weigh(word)
            if got:
                at.append(i)
                heavy.append((word, got))
        best = -np.inf
        for lo, hi in windows_of(len(words)):
            found = Counter(heavy[bisect_left(at, lo) : bisect_left(at, hi)])
            best = max(best, sum(v * c**0.5 for (_, v), c in sorted(found.items())))
        return float(best)

    def severity(self, margins: np.ndarray) -> np.ndarray:
        """P(grade > k) for each cut, as columns; their sum is the expected grade."""
        return 1 / (1 + np.exp(-np.clip(margins[:, None] - self.cuts[None, :], -50, 50)))


def telling_words(texts: list[list[bytes]], toxic: np.ndarray) -> set[bytes]:
    """Words at least eight times as frequent, by documents, in toxic as in clean labelled texts."""
    n1, n0 = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    bad, good = Counter(), Counter()
    for words, t in zip(texts, toxic, strict=True):
        (bad if t else good).update(set(words))
    return {w for w, c in bad.items() if c >= MIN_TEXTS and c / n1 >= 8 * (good[w] + 1) / n0}


def grades(texts: list[list[bytes]], toxic: np.ndarray, telling: set[bytes]) -> np.ndarray:
    """Ordered grades from 0/1 labels. What orders toxic texts is how densely the words that mark them stand where they stand most
    densely: a text is 2 rather than 1 if its largest share of telling words in a window is above the toxic texts' median.

    Labels of more than two grades would take the place of this; the regression itself only asks for ordered grades.
    """

    def share(words: list[bytes]) -> float:
        return max(sum(w in telling for w in words[lo:hi]) / max(1, hi - lo) for lo, hi in windows_of(len(words)))

    shares = np.array([share(words) if t else 0.0 for words, t in zip(texts, toxic, strict=True)])
    middle = np.median(shares[toxic == 1]) if toxic.any() else 0.0
    return np.where(toxic == 0, 0, np.where(shares > middle, 2, 1))


def fit(texts: list[str], toxic: list[int], l1: float = 5e-4, steps: int = 300, rate: float = 0.05) -> Ordinal:
    """Adam with an L1 shrinkage on the cumulative-link likelihood; deterministic.

    The likelihood of a grade is the difference of its neighbouring cuts' probabilities. A text counts by its worst window, chosen anew
    every ten steps by the weights then held, and at first by the number of telling words.
    """
    toxic = np.asarray(toxic, np.int64)
    if not toxic.any() or toxic.all():
        return Ordinal({}, np.array([30.0, 31.0]) if not toxic.any() else np.array([-30.0, 30.0]))
    words = [words_of(t) for t in texts]
    telling = telling_words(words, toxic)
    grade = grades(words, toxic, telling)
    seen: Counter = Counter()
    for own in words:
        seen.update({f for w in set(own) for f in features_of(w)})
    common = sorted(((f, c) for f, c in seen.items() if c >= MIN_TEXTS), key=lambda x: (-x[1], x[0]))
    vocabulary = {f: i for i, (f, _) in enumerate(common)}
    del seen
    number: dict[bytes, int] = {}
    feats: list[list[int]] = []
    pairs, roots, sizes, n_windows = [], [], [], []
    for own in words:
        for word in own:
            if word not in number:
                number[word] = len(number)
                feats.append([vocabulary[f] for f in features_of(word) if f in vocabulary])
        ids = np.array([number[word] for word in own], np.int32)
        held = [np.unique(ids[lo:hi], return_counts=True) for lo, hi in windows_of(len(own))]
        pairs += [x for x, _ in held]
        roots += [c**0.5 for _, c in held]
        sizes += [len(x) for x, _ in held]
        n_windows.append(len(held))
    # window k of the texts holds the words pairs[k], roots[k]**2 times each; word j has the features of_word[ends[j] - per_word[j] : ends[j]]
    per_word = np.array([len(x) for x in feats], np.int64)
    ends = np.cumsum(per_word)
    of_word = np.fromiter((f for x in feats for f in x), np.int64, int(per_word.sum()))
    spots = np.repeat(np.arange(len(sizes)), sizes)
    flat, times = np.concatenate(pairs), np.concatenate(roots)
    first = np.concatenate([[0], np.cumsum(n_windows)[:-1]])
    n, m = len(words), len(vocabulary)

    def worst(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, features and values of each text's window of the largest margin, the earliest of equal ones."""
        weight = np.bincount(np.repeat(np.arange(len(per_word)), per_word), w[of_word], minlength=len(per_word))
        margins = np.bincount(spots, weight[flat] * times, minlength=len(sizes))
        chosen = [a + int(np.argmax(margins[a : a + k])) for a, k in zip(first, n_windows, strict=True)]
        rows = np.repeat(np.arange(n), [per_word[pairs[k]].sum() for k in chosen])
        cols = [of_word[ends[j] - per_word[j] : ends[j]] for k in chosen for j in pairs[k]]
        values = [np.repeat(roots[k], per_word[pairs[k]]) for k in chosen]
        return rows, np.concatenate([np.zeros(0, np.int64), *cols]), np.concatenate(values)

    w, cuts = np.zeros(m), np.array([2.0, 3.0])
    g1, g2, c1, c2 = np.zeros(m), np.zeros(m), np.zeros(2), np.zeros(2)
    for step in range(1, steps + 1):
        if step % 10 == 1:
            rows, cols, values = worst(w if step > 1 else np.array([float(f in telling) for f in vocabulary]))
        x = np.bincount(rows, w[cols] * values, minlength=n)
        p = 1 / (1 + np.exp(-np.clip(x[:, None] - cuts[None, :], -30, 30)))
        above = np.concatenate([np.ones((n, 1)), p, np.zeros((n, 1))], 1)
        slope = above * (1 - above)
        i = np.arange(n)
        likely = np.maximum(above[i, grade] - above[i, grade + 1], 1e-9)
        dx = -(slope[i, grade] - slope[i, grade + 1]) / likely / n
        dc = np.array([((grade == k + 1) * slope[:, k + 1] / likely - (grade == k) * slope[:, k + 1] / likely).sum() / n for k in range(2)])
        g = np.bincount(cols, dx[rows] * values, minlength=m)
        g1, g2 = 0.9 * g1 + 0.1 * g, 0.999 * g2 + 0.001 * g * g
        c1, c2 = 0.9 * c1 + 0.1 * dc, 0.999 * c2 + 0.001 * dc * dc
        a, b = 1 - 0.9**step, 1 - 0.999**step
        w -= rate * (g1 / a) / (np.sqrt(g2 / b) + 1e-6)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1 / (np.sqrt(g2 / b) + 1e-6), 0)
        cuts -= rate * (c1 / a) / (np.sqrt(c2 / b) + 1e-6)
        cuts[1] = max(cuts[1], cuts[0] + 1e-3)
    return Ordinal({f: float(w[i]) for f, i in vocabulary.items() if w[i]}, cuts)


def fit_on(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_bytes: int = MAX_TRAIN_BYTES, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Ordinal:
    """Fit on at most ``max_train`` labelled documents, chosen by a hash of their id.

    Rows with a null id or label and texts of more than ``max_bytes`` bytes are not learnt from, so that what comes to the driver
    is bounded. Of labels that repeat an id the larger counts, of documents any one. Without toxic labels nothing is rejected.
    """
    chosen = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id is not null and _y is not null")
    chosen = chosen.groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(max_train)
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")).where(F.octet_length("_text") <= max_bytes).join(F.broadcast(chosen), "_id").select("_id", "_text", "_y").collect()
    rows = sorted({r["_id"]: r for r in rows}.values(), key=lambda r: r["_id"])
    return fit([r["_text"] for r in rows], [r["_y"] for r in rows])


def score(docs: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, margin, p_mild, p_severe, severity (expected grade, 0 to 2) and toxic (p_mild >= THRESHOLD).

    The whole text counts. Null and empty texts have no words, so the cuts alone judge them; a null id stays null; equal texts
    have equal results, repeated rows one each; other columns are not looked at. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = np.array([model.margin(t.as_py()) for t in batch.column(1)], float)
            p = model.severity(margins)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (margins, p[:, 0], p[:, 1], p.sum(1), p[:, 0] >= THRESHOLD))], ["doc_id", "margin", "p_mild", "p_severe", "severity", "toxic"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return base.transform(map_batches, run, "doc_id long, margin double, p_mild double, p_severe double, severity double, toxic boolean")


def keep_clean(docs: DataFrame, model: Ordinal, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text the model rejects; columns unchanged, whatever their names; no shuffle.

    Each row is judged by its whole text alone, so repeated rows stay or go together and null ids make no difference. Null and
    empty texts are judged by the model's cuts alone. An empty table gives no rows.
    """
    at, names = docs.columns.index(text_col), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = np.array([model.margin(t.as_py() or "") for t in batch.column(at)], float)
            kept = model.severity(margins)[:, 0] < THRESHOLD
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(kept)) for c in batch.columns], names)

    return docs.transform(map_batches, run, docs.schema)
