"""MinHash near-deduplication with min-max signatures, exact confirmation and connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BITMAP_BITS, bitmap, bitmap_marked, bitmap_slot, map_batches, parted, release, text_or_empty, unused_names, written
from .components import connected_components

#: 40 bands of 6 values (minimum and maximum under three permutations): documents of similarity 0.8 share no band once in
#: 200,000, those of 0.5 do so in 47 of 100 cases and those of 0.3 in 3.
BANDS, PERMUTATIONS_PER_BAND = 40, 3
PERMUTATIONS = BANDS * PERMUTATIONS_PER_BAND
#: Members and queries of a star are compared in blocks of about this many shingles; a set weighs its size and a constant,
#: so that a block holds at most about 500 sets. Blocks by weight bound a task's memory and copy short sets seldom.
BLOCK_SHINGLES, SET_WEIGHT = 1 << 15, 64

_rng = np.random.default_rng(20240229)
_A = (_rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
_MIX, _FIN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class Shingles:
    """Distinct 64-bit hashes of a text's word shingles: A-Z lower-cased, words parted by ASCII blanks.

    A text with fewer words than a shingle has is one shingle; a text without words has none. Hashes of words are kept in
    a bounded table.
    """

    def __init__(self, words: int, most_kept: int = 1 << 16):
        self.words, self.most_kept, self.kept = words, most_kept, {}

    def _hash(self, word: bytes) -> int:
        got = xxhash.xxh3_64_intdigest(word)
        if len(self.kept) >= self.most_kept:
            self.kept.clear()
        if len(word) <= 32:
            self.kept[word] = got
        return got

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        get, own = self.kept.get, self._hash
        hashes = np.array([h if (h := get(w)) is not None else own(w) for w in words], np.uint64)
        k = min(self.words, len(words))
        n = len(words) - k + 1
        out = hashes[:n] + np.uint64(k)
        for i in range(1, k):
            out = (out ^ (out >> np.uint64(29))) * _MIX + hashes[i : n + i]
        out ^= out >> np.uint64(31)
        out *= _FIN
        out ^= out >> np.uint64(27)
        out.sort()
        return out[np.concatenate([[True], out[1:] != out[:-1]])]


def min_max_bands(shingles: np.ndarray) -> np.ndarray:
    """A key for each band, from the minimum and the maximum of the shingles under each permutation."""
    low, high = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
    for i in range(0, len(shingles), 4096):
        x = shingles[None, i : i + 4096] * _A[:, None] + _B[:, None]
        x ^= x >> np.uint64(32)
        np.minimum(low, x.min(1), out=low)
        np.maximum(high, x.max(1), out=high)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _FIN
    for values in np.stack([low, high], 1).reshape(BANDS, -1).T:
        key = ((key ^ (key >> np.uint64(29))) + values) * _MIX
    return (key ^ (key >> np.uint64(32))).view(np.int64)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(_id, _n, _set, _bands) of docs (_id, _data): size and 128-bit digest of the shingle set, and the band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingles(words)
        for batch in batches:
            n, digest, bands = [], [], []
            for text in batch.column(1):
                own = shingle(text.as_py())
                n.append(len(own))
                digest.append(xxhash.xxh3_128_digest(own.tobytes()))
                bands.append(min_max_bands(own) if len(own) else np.zeros(0, np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(b) for b in bands])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), lists], ["_id", "_n", "_set", "_bands"])

    return docs.transform(map_batches, run, "_id long, _n long, _set binary, _bands array<long>")


def _sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(_node, _tokens) for the documents whose id is in ``ids`` (_node); a bitmap of fixed size keeps other texts unmoved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingles(words)
        for batch in batches:
            sets = [shingle(t.as_py()).view(np.int64) for t in batch.column(1)]
            offsets = np.concatenate([[0], np.cumsum([len(b) for b in sets])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["_node", "_tokens"])

    slot = bitmap_slot(F.xxhash64("_node"), BITMAP_BITS)
    near = bitmap_marked(docs.withColumnRenamed("_id", "_node"), bitmap(ids, slot), slot, "_wanted").where("_wanted").drop("_wanted")
    exact = near.join(ids.withColumnRenamed("_node", "_want"), F.col("_node") == F.col("_want"), "left_semi")
    return exact.groupBy("_node", F.xxhash64("_data").alias("_text")).agg(F.min("_data").alias("_data")).select("_node", "_data").transform(map_batches, run, "_node long, _tokens array<long>").where("size(_tokens) > 0")


def prefixes(sets: list[np.ndarray], threshold_pct: int) -> list[np.ndarray]:
    """Of each set its rarest tokens, by their frequency in all the sets, so many that two sets as similar as asked for must share
    one: of n tokens all but (the least number that can be shared) and one."""
    sizes = np.array([len(x) for x in sets])
    flat = np.concatenate(sets)
    _, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    own = np.repeat(np.arange(len(sets)), sizes)
    order = np.lexsort((flat, counts[inverse], own))
    rank = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    kept = sizes - (threshold_pct * sizes + 99) // 100 + 1
    flat = flat[order][rank < np.repeat(kept, sizes)]
    return np.split(flat, np.cumsum(np.minimum(kept, sizes))[:-1])


def block_links(queries: list[tuple[int, int, np.ndarray]], members: list[tuple[int, int, np.ndarray]], threshold_pct: int) -> tuple[list[tuple[int, int]], int]:
    """Links of queries (node, component, tokens) to the smallest member of each other component, and the number of pairs compared:
    those of like size that share a token of their prefixes."""
    found, compared = [], 0
    if not queries or not members:
        return found, compared
    rare = prefixes([t for *_, t in queries] + [t for *_, t in members], threshold_pct)
    sizes = np.array([len(t) for *_, t in members], np.int64)
    tokens, begin = np.concatenate([t for *_, t in members]), np.cumsum(sizes) - sizes
    index = np.concatenate(rare[len(queries) :])
    holder = np.repeat(np.arange(len(members)), [len(x) for x in rare[len(queries) :]])
    order = np.argsort(index, kind="stable")
    index, holder = index[order], holder[order]
    nodes, comps = np.array([m[0] for m in members]), np.array([m[1] for m in members])
    for (node, comp, own), mine in zip(queries, rare, strict=False):
        a, b = np.searchsorted(index, mine, "left"), np.searchsorted(index, mine, "right")
        hits = b - a
        near = np.unique(holder[np.repeat(a - (np.cumsum(hits) - hits), hits) + np.arange(hits.sum())])
        n = np.int64(len(own))
        near = near[(comps[near] != comp) & (100 * np.minimum(sizes[near], n) >= threshold_pct * np.maximum(sizes[near], n))]
        if not len(near):
            continue
        compared += len(near)
        many = sizes[near]
        at = np.repeat(begin[near] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        theirs = tokens[at]
        both = np.add.reduceat(own[np.minimum(np.searchsorted(own, theirs), n - 1)] == theirs, np.cumsum(many) - many, dtype=np.int64)
        like = near[100 * both >= threshold_pct * (many + n - both)]
        found += [(int(node), int(nodes[like[comps[like] == c]].min())) for c in np.unique(comps[like])]
    return found, compared


def _compare_blocks(threshold_pct: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = lambda part: [(n, c, np.sort(t)) for n, c, t in zip(part["_node"], part["_comp"], part["_tokens"], strict=True)]
        found, _ = block_links(rows(pdf[pdf["_query"]]), rows(pdf[~pdf["_query"]]), threshold_pct)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold_pct: int = 80) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept (id = component_id).

    Documents are linked when 100 * intersection >= ``threshold_pct`` * union of their shingle sets. Documents with equal
    sets form one node, the smallest id. Nodes sharing a band meet in the star of the band's smallest node. First every
    member is confirmed against its star's node, on full sets. Then the members that are still in another component than
    the star's node are compared, in blocks of like sizes, with the members of other components in that star that share one of
    their rarest shingles, so that no link between two documents that share a band is lost.

    Null and empty texts and texts without words have no shingles and are linked with nothing. Rows that repeat an id are one
    document, with all that any of its texts is linked with. A row with a null id is linked with nothing; its component_id is
    null and it stays. An empty table gives no rows.
    """
    base = docs.select(F.col(id_col).cast("long").alias("_id"), F.encode(text_or_empty(text_col), "UTF-8").alias("_data"))
    light = written(signatures(base, words), "near-light")
    known = light.where("_n > 0 and _id is not null")
    reps = written(known.groupBy("_n", "_set").agg(F.min("_id").alias("_node"), F.first("_bands").alias("_bands")), "near-nodes")
    nodes = reps.select(F.col("_n").alias("_rn"), F.col("_set").alias("_rset"), "_node")
    same_set = (F.col("_n") == F.col("_rn")) & (F.col("_set") == F.col("_rset"))
    several = written(known.groupBy("_id").agg(F.min("_set").alias("_a"), F.max("_set").alias("_b")).where("_a <> _b").select(F.col("_id").alias("_several")), "near-several")

    bands = reps.select("_node", "_n", F.explode("_bands").alias("_band"))
    tops = written(bands.groupBy("_band").agg(F.min(F.struct("_node", "_n")).alias("_top"), F.max("_node").alias("_last")).where("_top._node <> _last").select(F.col("_band").alias("_key"), F.col("_top._node").alias("_hub"), F.col("_top._n").alias("_hub_n")), "near-tops")
    stars = written(bands.join(tops, F.col("_band") == F.col("_key")).where("_node <> _hub").select("_hub", "_node", "_n", "_hub_n").distinct(), "near-stars")
    release(tops)

    sets = written(_sets(base, stars.select("_node").unionByName(stars.select(F.col("_hub").alias("_node"))).distinct(), words), "near-sets")
    close = stars.where(f"100 * least(_n, _hub_n) >= {threshold_pct} * greatest(_n, _hub_n)")
    hubs = sets.select(F.col("_node").alias("_h"), F.col("_tokens").alias("_hub_tokens"))
    members = sets.withColumnRenamed("_node", "_m")
    own = (F.col("_node") == F.col("_m")) & (F.col("_n") == F.size("_tokens"))
    size = lambda c: F.size(c).cast("long")
    both = size(F.array_intersect("_tokens", "_hub_tokens"))
    like = 100 * both >= threshold_pct * (size("_tokens") + size("_hub_tokens") - both)
    links = close.join(members, own).join(hubs, F.col("_hub") == F.col("_h")).where(like).select(F.col("_node").alias("a"), F.col("_hub").alias("b"))
    if not several.isEmpty():
        links = links.unionByName(known.join(several, F.col("_id") == F.col("_several")).join(nodes, same_set).select(F.col("_id").alias("a"), F.col("_node").alias("b")))
    links = written(links, "near-links")
    first = written(connected_components(links), "near-components")
    release(links, several)

    named = first.select(F.col("node").alias("_c"), F.col("component").alias("_comp"))
    placed = stars.join(named, F.col("_node") == F.col("_c"), "left").select("_hub", "_node", "_n", F.coalesce("_comp", "_node").alias("_comp"))
    top = first.select(F.col("node").alias("_t"), F.col("component").alias("_top"))
    placed = placed.join(top, F.col("_hub") == F.col("_t"), "left").select("_hub", "_node", "_n", "_comp", F.coalesce("_top", "_hub").alias("_hub_comp"))
    # sizes of linked sets differ by the threshold at most, so their classes are the same or neighbours
    class_ = F.floor(F.log(F.col("_n").cast("double")) / F.lit(math.log(100 / threshold_pct) + 1e-9)).cast("int")
    placed = written(placed.withColumn("_class", class_), "near-placed")
    weight = F.col("_n") + SET_WEIGHT
    asked = placed.where("_comp <> _hub_comp").select("_hub", "_node", "_n", "_comp", F.explode(F.array(F.col("_class") - 1, F.col("_class"), F.col("_class") + 1)).alias("_class"))
    strays = asked.groupBy("_hub", "_class").agg(F.sum(weight).alias("_strays")).withColumnsRenamed({"_hub": "_star", "_class": "_star_class"})
    there = placed.groupBy("_hub", "_class").agg(F.sum(weight).alias("_weight"))
    same_star = (F.col("_hub") == F.col("_star")) & (F.col("_class") == F.col("_star_class"))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK_SHINGLES).cast("int")
    open_stars = written(there.join(strays, same_star).select("_star", "_star_class", blocks("_weight").alias("_blocks"), blocks("_strays").alias("_query_blocks")), "near-open")
    slots = lambda n: F.pmod(F.xxhash64("_node", F.lit(n)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    as_member = placed.join(open_stars, same_star).select("_hub", "_class", "_node", "_n", "_comp", slots("_blocks").alias("_i"), every("_query_blocks").alias("_j"), F.lit(False).alias("_query"))
    as_query = asked.join(open_stars, same_star).select("_hub", "_class", "_node", "_n", "_comp", every("_blocks").alias("_i"), slots("_query_blocks").alias("_j"), F.lit(True).alias("_query"))
    dealt = as_member.unionByName(as_query).join(members, own).select("_hub", "_class", "_i", "_j", "_query", "_node", "_comp", "_tokens")
    more = written(dealt.groupBy("_hub", "_class", "_i", "_j").applyInPandas(_compare_blocks(threshold_pct), "a long, b long"), "near-more")
    release(sets, stars, placed, open_stars)
    final = first
    if not more.isEmpty():
        final = written(connected_components(more.unionByName(first.select(F.col("node").alias("a"), F.col("component").alias("b")))), "near-components")
        release(first)
    release(more)

    comps = final.select(F.col("node").alias("_f"), F.col("component").alias("_component"))
    named = known.join(nodes, same_set).join(comps, F.col("_node") == F.col("_f"), "left")
    rows = named.select("_id", "_n", F.coalesce("_component", "_node").alias("_component"))
    alone = light.where("_n = 0 or _id is null").select("_id", "_n", F.col("_id").alias("_component"))
    return rows.unionByName(alone).select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), F.col("_component").alias("component_id"), F.col("_id").eqNullSafe(F.col("_component")).alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold_pct: int = 80) -> DataFrame:
    """``docs`` with one document of each component, that with the smallest id; columns unchanged.

    Rows that repeat an id are one document: they stay or go together, but of those with the same text only one stays. Rows with
    a null id, null or empty texts and texts without words all stay. Columns may have any names. An empty table gives no rows.
    """
    id_, = unused_names(docs.columns, "_dropped_id")
    judged = near_duplicates(docs, id_col, text_col, words, threshold_pct).select(F.col(id_col).alias(id_), "kept")
    judged = written(judged.where(F.col(id_).isNotNull()).groupBy(id_).agg(F.min("kept").alias("kept"), F.count(F.lit(1)).alias("n")), "near-judged")
    dropped, several = judged.where("not kept").select(id_), judged.where("kept and n > 1").select(id_)
    same = F.col(id_col).cast("long") == F.col(id_)
    stay, near = parted(docs, dropped, bitmap_slot(F.xxhash64(F.col(id_col).cast("long")), BITMAP_BITS), bitmap_slot(F.xxhash64(F.col(id_)), BITMAP_BITS))
    out = stay.unionByName(near.join(dropped, same, "left_anti"))
    if several.isEmpty():
        return out
    return out.join(several, same, "left_anti").unionByName(out.join(several, same, "left_semi").dropDuplicates([id_col, text_col]))
