"""Each operator against a brute-force version, on whole texts with nulls, ties, repeats and clashing names."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trajlake.llm import exact_dedup, media, mixing, near_dedup, packing, quality, secrets, suffix_dedup, toxicity, warc
from trajlake.llm.components import connected_components
from trajlake.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id int, _text string, keep_id string"
WORDS = ["the", "and", "Größe", "été", "ing", "tion", "of", "blen", "sher", "ñado", "ONE", "two.", "three,"]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    make = lambda n: " ".join(r.choice(WORDS) + r.choice(["", "", "x", "zu"]) + r.choice(["", "\n"]) for _ in range(n))
    base = [make(n) for n in (0, 1, 2, 3, 40, 90, 200, 400)]
    texts = [*base, *base[3:6], base[5].upper(), base[5].replace("the", "THE"), None, None, "", "   ", "a", "aa" * 300, "ab " * 200, "\t\n", "x  y   z ", "<|endoftext|> there", make(6000)]
    for k in range(12):
        words = base[6].split(" ")
        for _ in range(k):
            words[r.randrange(len(words))] = f"edit{r.randrange(9999)}"
        texts.append(" ".join(words))
    texts += [make(20) + base[6][30:300] + make(30), base[7][100:500] + base[7][100:500]]
    out = [(i, t, "en", [None, "a", "b", "c", ""][i % 5], 1, 7, "clash", "x") for i, t in enumerate(texts)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_exact_groups(docs, rows, empty, spark):
    lower = lambda t: (t or "").encode().lower()
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(lower(t), []).append(i)
    got = {r["doc_id"]: r for r in exact_dedup.exact_groups(docs, carry={"h": F.sha2("_text", 256)}).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        own = groups[lower(t)]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(own), len(own), i == max(own))
        assert got[i]["h"] == hashlib.sha256(lower(t)).hexdigest()
    assert exact_dedup.deduplicate(docs).count() == len(groups) and exact_dedup.deduplicate(docs).columns == docs.columns
    assert exact_dedup.exact_groups(empty).count() == 0
    odd = spark.createDataFrame([(None, "q"), (3, "Q"), (3, "Q"), (None, "only")], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(odd, bitmap_bits=64).collect()) == [("3", "3", 3, True), ("3", "3", 3, True), ("None", "3", 3, False), ("None", "None", 1, True)]


def test_deduplicate_keeps_one_of_repeated_rows(spark):
    rows = [(1, "Same", "a"), (1, "Same", "b"), (1, "other", "c"), (2, "SAME", "d"), (3, "lone", "e"), (3, "LONE", "f"), (None, "null", "g"), (None, "NULL", "h"), (None, "other", "i"), (4, None, "j"), (5, "", "k")]
    names = ["doc_id", "text", "_dropped_id", "_dropped_full", "_size"]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, _dropped_id string, _dropped_full string, _size int")
    got = exact_dedup.deduplicate(df)
    assert got.columns == names
    assert sorted((str(r["doc_id"]), (r["text"] or "").lower()) for r in got.collect()) == [("1", "other"), ("2", "same"), ("3", "lone"), ("5", ""), ("None", "null")]


def shingles(text, k):
    w = (text or "").encode().lower().split()
    k = min(k, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


@pytest.mark.parametrize("k,block", [(2, near_dedup.BLOCK_SHINGLES), (5, near_dedup.BLOCK_SHINGLES), (2, 150), (5, 150)])
def test_near_duplicates(docs, rows, empty, k, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", block)
    sets = {i: shingles(t, k) for i, t, *_ in rows}
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and comp[b] < comp[a]:
                    comp[a], changed = comp[b], True
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs, words=k).collect()}
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(sets[i]), comp[i], comp[i] == i) for i in sets}
    assert near_dedup.near_duplicates(empty, words=k).count() == 0


def test_near_duplicates_of_rows_with_one_id(spark):
    r = random.Random(12)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    a, b, c = words(40), words(60), words(50)
    like = lambda w: " ".join([*w[:-1], "other"])
    rows = [(7, " ".join(a)), (7, " ".join(b)), (9, like(b)), (8, like(a)), (3, " ".join(c)), (12, " ".join(b)), (12, like(c)), (None, " ".join(a)), (20, None), (20, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((x["doc_id"], x["component_id"], x["kept"]) for x in near_dedup.near_duplicates(df, words=2).collect()), key=str)
    one = 3  # 12 is like 3 and like 7, so all are one group
    want = [(7, one, False), (7, one, False), (9, one, False), (8, one, False), (3, 3, True), (12, one, False), (12, one, False), (None, None, True), (20, 20, True), (20, 20, True)]
    assert got == sorted(want, key=str)
    stay = near_dedup.deduplicate(df.withColumn("_dropped_id", F.lit("x")), words=2)
    assert stay.columns == ["doc_id", "text", "_dropped_id"] and sorted((str(x["doc_id"]), x["text"]) for x in stay.collect()) == sorted([("3", " ".join(c)), ("None", " ".join(a)), ("20", None)], key=str)


def test_pairs_compared_in_a_star_grow_with_its_members_not_their_square():
    r = np.random.default_rng(3)
    common = np.arange(100, dtype=np.int64)

    def members(n):  # each shares half of its tokens with all others, and every tenth one is like the one before
        own = [np.sort(np.concatenate([common, 10**6 * (k + 1) + r.choice(10**5, 100, replace=False)])) for k in range(n)]
        for k in range(10, n, 10):
            own[k] = np.sort(np.concatenate([own[k - 1][:-5], 10**12 + k * 10 + np.arange(5)]))
        return [(k, k, t) for k, t in enumerate(own)]

    compared = []
    for n in (50, 100, 200):
        m = members(n)
        found, pairs = near_dedup.block_links(m, m, 80)
        want = {(a, b) for a, _, x in m for b, _, y in m if a != b and 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y))}
        assert set(found) == want and len(want) > n / 10
        compared.append(pairs)
    assert all(pairs <= n / 4 for pairs, n in zip(compared, (50, 100, 200), strict=True))


def test_components(spark):
    r = random.Random(2)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)]
    comp = {x: x for p in pairs for x in p if p[0] != p[1]}
    for _ in range(60):
        for a, b in pairs:
            if a != b:
                comp[a] = comp[b] = min(comp[a], comp[b])
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame([*pairs, (None, 1)], "a long, b long")).collect()}
    assert got == comp


def test_remove_repeats(docs, rows, empty):
    seen, want = set(), {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(b[s : s + 100])
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want[i] = (len(b), sum(gone), sum(1 for x in bytes(gone).split(b"\0") if x), hashlib.sha256(left).hexdigest(), left)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(docs, keep_text=True).collect()}
    assert got == want and sum(w[1] for w in want.values()) > 2000
    assert suffix_dedup.remove_repeats(empty).count() == 0


def repeats(rows):
    """Kept bytes, removed bytes and spans of (id, text) in the order given, by every window of 100 bytes."""
    seen, out = set(), []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(b[s : s + 100])
        out.append((i, len(b), sum(gone), sum(1 for x in bytes(gone).split(b"\0") if x), bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def removed(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in df.collect()), key=str)


@pytest.mark.parametrize("setting", [{"STRETCH": 700, "SEGMENT": 500}, {"HOT": 3, "HOT_SAMPLE": 1, "SEGMENT": 2000}, {"WINDOWS": 50, "BATCH": 4, "MARKS": 10}])
def test_repeats_whatever_the_sizes_of_segments_batches_and_hot_pieces(spark, setting, monkeypatch):
    r = random.Random(1)
    line = "a line that stands in nearly every text, and then some more of it to pass a hundred bytes at all events; "
    word = lambda: "".join(r.choices("abcdef", k=r.randint(1, 9)))
    make = lambda n: " ".join(word() for _ in range(n))
    long = make(300)
    rows = [(i, make(r.randint(0, 40)) + line[: r.choice([40, 70, 99, 105])] + make(r.randint(0, 40))) for i in range(60)]
    rows += [(100, long + long[200:900] + long[:90]), (101, make(4) + long[100:700] + make(9)), (102, "ab" * 400), (103, "\0" * 250 + "x" + "\0" * 250), (104, long)]
    for k, v in setting.items():
        monkeypatch.setattr(suffix_dedup, k, v)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert removed(suffix_dedup.remove_repeats(docs, keep_text=True)) == sorted(repeats(rows), key=str)
    ends = np.cumsum([len(t.encode()) for _, t in rows])
    text = "".join(t for _, t in rows).encode()
    hot = np.sort(np.unique(suffix_dedup.piece_hashes(np.frombuffer(line.encode(), np.uint8))))
    covered = set()
    for a, _, _, lo, hi, _ in suffix_dedup._stretches(text, ends, hot):
        covered |= {a + s for x, y in zip(lo.tolist(), hi.tolist(), strict=True) for s in range(x, y + 1)}
    assert covered == {s for e, (_, t) in zip(ends.tolist(), rows, strict=True) for s in range(e - len(t.encode()), e - 99)}


def test_repeats_of_rows_with_one_id_and_of_null_ids(spark):
    r = random.Random(3)
    make = lambda n: "".join(r.choices("abcdefgh ", k=n))
    one, two, three = make(280), make(288), make(400)
    rows = [(7, one + one), (7, two + two + two), (9, three), (None, three + one), (None, make(500)), (11, None), (12, two), (12, two)]
    got = removed(suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), keep_text=True))
    want = [*repeats([(7, one + one), (7, two + two + two), (9, three), (12, two), (12, two), (11, None), (None, three + one)]), *repeats([(None, rows[4][1])])]
    assert got == sorted(want, key=str)


def test_a_stored_family_is_an_index_for_later_documents(spark, tmp_path):
    r = random.Random(5)
    make = lambda n: "".join(r.choices("abcdefgh ", k=n))
    first = [(i, make(r.randint(0, 900))) for i in range(20)]
    first.append((20, first[3][1] + first[4][1]))
    second = [(1, make(150) + first[5][1][50:400] + make(20)), (2, first[6][1]), (3, make(300)), (4, make(10) + first[20][1][:500])]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    store = f"file://{tmp_path}/family"
    assert removed(suffix_dedup.remove_repeats(frame(first), keep_text=True, store=store)) == sorted(repeats(first), key=str)
    assert removed(suffix_dedup.remove_repeats(frame(second), keep_text=True, index=store)) == sorted(repeats([*first, *second])[len(first) :], key=str)


def test_suffix_family_keeps_the_earliest_in_text_order():
    r = np.random.default_rng(4)
    family, everything, gone = suffix_dedup.SuffixFamily(), [], []
    for b in range(9):
        n = 200 >> (b % 3)
        text = np.zeros((n, suffix_dedup.STORED), np.uint8)
        text[:, :100] = r.integers(97, 99, (n, 1)) + (np.arange(100)[None] > r.integers(0, 90, (n, 1)))
        new = suffix_dedup.Suffixes(text.reshape(-1).view(f"S{suffix_dedup.STORED}"), r.integers(0, 50, n), np.zeros(n, np.int64), np.arange(n) + 1000 * b, r.integers(0, 9, n), np.zeros(n, np.uint8))
        everything.append(new)
        gone.append(family.add(new))
        assert all((x.text[:-1] < x.text[1:]).all() for x in family.levels) and all(len(a) > 2 * len(b) for a, b in zip(family.levels, family.levels[1:], strict=False))
    whole, all_ = family.whole(), suffix_dedup.Suffixes.concat(everything)
    place = lambda s: list(zip(s.text.tolist(), s.id.tolist(), s.tie.tolist(), s.ref.tolist(), s.pos.tolist(), strict=True))
    first = {}
    for t, i, _, ref, pos in place(all_):
        first[t] = min(first.get(t, (i, ref, pos)), (i, ref, pos))
    assert {t: (i, ref, pos) for t, i, _, ref, pos in place(whole)} == first
    assert sorted(place(whole) + place(suffix_dedup.Suffixes.concat(gone))) == sorted(place(all_))
    own = whole.bytes()[:, :100].astype(int)
    same = (own[:, None] == own[None]).cumprod(2).sum(2) * (1 - np.eye(len(own), dtype=int))
    assert (whole.like == same.max(1)).all()


def test_media(docs, rows, empty):
    stored = media.media_column(docs)
    got = {r["doc_id"]: r for r in media.media_features(stored).collect()}
    for i, t, *_ in rows:
        b = (t or "").encode()
        padded = b + bytes(-len(b) % 64 if b else 64)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert all(hashlib.sha256(r["media"]).hexdigest() == got[r["doc_id"]]["media_sha256"] for r in stored.collect())
    assert media.media_features(media.media_column(empty)).count() == 0


def test_png_filters_and_checksums():
    import struct

    image = np.random.default_rng(0).integers(0, 256, (9, 64), dtype=np.uint8)
    for kind in (media.NONE, media.SUB, media.UP):
        assert (media.decode_png(media.encode_png(image, kinds=(kind,))) == image).all()
    kinds = [4, 3, 1, 2, 0, 4, 4, 3, 2]
    raw = bytearray()
    for y, kind in enumerate(kinds):
        raw.append(kind)
        for x in range(64):
            left, up, corner = int(image[y, x - 1]) if x else 0, int(image[y - 1, x]) if y else 0, int(image[y - 1, x - 1]) if x and y else 0
            p = left + up - corner
            paeth = left if abs(p - left) <= abs(p - up) and abs(p - left) <= abs(p - corner) else up if abs(p - up) <= abs(p - corner) else corner
            raw.append((int(image[y, x]) - (0, left, up, (left + up) // 2, paeth)[kind]) & 255)
    png = media.SIGNATURE + media._chunk(b"IHDR", struct.pack(">IIBBBBB", 64, 9, 8, 0, 0, 0, 0)) + media._chunk(b"IDAT", zlib.compress(bytes(raw))) + media._chunk(b"IEND", b"")
    assert (media.decode_png(png) == image).all()
    for bad in (png[:-5], png[1:], png[:45] + bytes([png[45] ^ 1]) + png[46:], b""):
        with pytest.raises(ValueError):
            media.decode_png(bad)
    assert media.dct_hash(image) == media.dct_hash(image.copy()) and len(media.dct_hash(image)) == 16


def test_png_rejects_what_is_malformed(spark):
    import struct

    image = np.random.default_rng(1).integers(0, 256, (40, 64), dtype=np.uint8)
    png = media.encode_png(image)
    header, rest = png[8:33], png[33:]
    short = media._chunk(b"IHDR", b"\0\0\0\x40")
    bomb = media.SIGNATURE + media._chunk(b"IHDR", struct.pack(">IIBBBBB", 64, 1, 8, 0, 0, 0, 0)) + media._chunk(b"IDAT", zlib.compress(bytes(10**7))) + rest[-12:]
    huge = media.SIGNATURE + media._chunk(b"IHDR", struct.pack(">IIBBBBB", 2**31, 2**31, 8, 0, 0, 0, 0)) + rest
    half = zlib.compress(bytes(65 * 40))
    parted = media.SIGNATURE + header + media._chunk(b"IDAT", half[:9]) + media._chunk(b"tEXt", b"a") + media._chunk(b"IDAT", half[9:]) + rest[-12:]
    bad = [media.SIGNATURE + short + rest, media.SIGNATURE + rest[:-12] + header + rest[-12:], png + b"x", png[:8] + header + png[8:], bomb, huge, parted, media.SIGNATURE + header + media._chunk(b"ABCD", b"") + rest, media.SIGNATURE]
    for x in bad:
        with pytest.raises(ValueError):
            media.decode_png(x)
    assert (media.decode_png(media.SIGNATURE + header + media._chunk(b"tEXt", b"a") + rest) == image).all()
    df = spark.createDataFrame([(i, bytearray(x), "clash", 3) for i, x in enumerate([*bad, png])] + [(99, None, "n", 3)], "doc_id long, media binary, payload_bytes string, feature int")
    got = {r["doc_id"]: r for r in media.media_features(df).collect()}
    assert [got[i]["payload_bytes"] for i in range(len(bad))] == [None] * len(bad) and got[len(bad)]["payload_bytes"] == image.size and got[99]["media_bytes"] is None
    assert media.media_features(df).columns == ["doc_id", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def test_each_row_of_an_image_has_the_filter_that_suits_it(spark):
    r = np.random.default_rng(5)
    image = r.integers(0, 256, (40000, 8), dtype=np.uint8)
    image[1::3] = image[::3][: len(image[1::3])]
    image[2::3] = np.arange(8, dtype=np.uint8) * 3
    kinds, left = media.filtered(image, (media.NONE, media.SUB, media.UP))
    assert set(kinds.tolist()) == {0, 1, 2}
    wide = image.astype(int)
    above, before = np.vstack([np.zeros((1, 8), int), wide[:-1]]), np.hstack([np.zeros((len(wide), 1), int), wide[:, :-1]])
    costs = np.stack([np.minimum(d % 256, -d % 256).sum(1) for d in (wide, wide - before, wide - above)])
    assert (kinds == costs.argmin(0)).all() and (media.unfilter(kinds, left) == image).all()
    assert (media.decode_png(media.encode_png(image)) == image).all()


def test_packing(docs, rows, empty):
    exact = packing.BpeIds(tokenizer_path())
    want = {i: [*exact.exact.encode(t or "", add_special_tokens=False).ids, 1] for i, t, *_ in rows}
    assert all(exact(t or "").tolist() == want[i][:-1] for i, t, *_ in rows)
    got = packing.pack(docs, tokenizer_path(), keep_ids=True, open_windows=3).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and r["doc_tokens"] == len(want[r["doc_id"]])
    for i, pieces in by_doc.items():
        pieces.sort(key=lambda r: r["start"])
        assert [r["start"] for r in pieces] == list(np.cumsum([0, *[r["length"] for r in pieces[:-1]]]))
        assert np.frombuffer(b"".join(r["ids"] for r in pieces), "<u4").tolist() == want[i]
    assert set(by_doc) == set(want)
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in pieces] == list(np.cumsum([0, *[r["length"] for r in pieces[:-1]]])) and sum(r["length"] for r in pieces) <= 2048
    # only documents of a window and more, and those at the borders of merged windows, are cut
    cut = [i for i, p in by_doc.items() if len(p) > 1 and len(want[i]) < 2048]
    assert len(cut) <= 3 * 3 + 1 and sum(sum(r["length"] for r in s) for s in by_seq.values()) == sum(map(len, want.values()))
    assert packing.pack(empty, tokenizer_path()).count() == 0


def test_packer_places_best_fit_and_emits_the_fullest_when_none_fits():
    ids = lambda n: np.arange(n, dtype="<u4")
    packer = packing.Packer(100, 2)
    closed = [list(packer.add(k, ids(n))) for k, n in enumerate((60, 70, 25, 50, 250, 55, 45))]
    places = [[[(t, s, len(x)) for t, s, x in w] for w in c] for c in closed]
    assert places == [[], [], [], [[(1, 0, 70), (2, 0, 25)]], [[(4, 0, 100)], [(4, 100, 100)], [(3, 0, 50), (4, 200, 50)]], [], [[(5, 0, 55), (6, 0, 45)]]]
    assert [[(t, s, len(x)) for t, s, x in w] for w in packer.merge()] == [] and [[(t, len(x)) for t, _, x in w] for w in packer.open] == [[(0, 60)]]
    r = np.random.default_rng(2)
    packer, sizes = packing.Packer(100, 4), r.integers(1, 300, 500)
    windows = [w for k, n in enumerate(sizes) for w in packer.add(k, ids(n))]
    before = len(windows)
    windows += [*packer.merge(), *packer.open]
    assert all(sum(len(x) for *_, x in w) <= 100 for w in windows) and sum(sum(len(x) for *_, x in w) < 100 for w in windows[before:]) <= 1
    found = {}
    for w in windows:
        for t, s, x in w:
            assert (x == ids(sizes[t])[s : s + len(x)]).all()
            found[t] = found.get(t, 0) + len(x)
    assert found == dict(enumerate(sizes.tolist()))
    assert sum(100 - sum(len(x) for *_, x in w) for w in windows) < 0.1 * sizes.sum()


def test_fit_budget_reaches_its_budget():
    r = np.random.default_rng(5)
    for _ in range(40):
        sizes = np.unique(r.integers(0, 400, 30))
        counts = r.integers(1, 9, len(sizes))
        budget = int(r.integers(0, (sizes * counts).sum() + 5))
        take = mixing.fit_budget(sizes, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        mixed = r.permutation(len(sizes))
        assert (mixing.fit_budget(sizes[mixed], counts[mixed], budget) == take[mixed]).all()
        reach = {0}
        for s, c in zip(sizes.tolist(), counts.tolist(), strict=True):
            reach = {a + k * s for a in reach for k in range(c + 1) if a + k * s <= 2 * budget}
        assert abs(budget - (take * sizes).sum()) <= min(abs(budget - a) for a in reach) + 2 or (take == counts).all()


def test_mix(docs, rows, empty, spark):
    import re

    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows}
    source = {i: s for i, _, _, s, *_ in rows}
    total = Counter()
    for i, s in source.items():
        total[s] += size[i]
    names = sorted((s for s in total if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(total.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * total[s]}
        if not over:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: 2.0 * total[s] for s in over}
        left -= sum(target[s] for s in over)
        open_ -= over
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == total[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
    for s in names:
        reach = {0}
        for i in (i for i in size if source[i] == s):
            reach = {a + k * size[i] for a in reach for k in ((1, 2) if target[s] >= total[s] else (0, 1))}
        assert abs(taken[s] - target[s]) <= min(abs(a - target[s]) for a in reach) + 0.05 * target[s] + 1
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    again = mixing.repeat(docs)
    assert again.columns == docs.columns and again.count() == sum(r["times"] for r in got)
    assert mixing.mix(empty).count() == 0


def test_repeat_gives_each_row_as_often_as_it_is_taken(spark):
    r = random.Random(2)
    words = lambda n: " ".join("w" for _ in range(n)) + f" {r.random()}"
    rows = [(None, words(k % 9), "a", "x") for k in range(50)] + [(1, "one and the same", "b", f"{k}") for k in range(10)] + [(k, words(30), "b", "x") for k in range(2, 8)] + [(9, None, None, "x"), (9, words(4), None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _taken_id string").withColumns({"_copy": F.lit(1), "_taken": F.lit(2)})
    times = mixing.mix(df).collect()
    got = mixing.repeat(df)
    assert got.columns == df.columns and got.count() == sum(t["times"] for t in times)
    key = lambda x: (x["doc_id"], x["source"])
    many = Counter()
    for t in times:
        many[key(t)] += t["times"]
    assert Counter(key(x) for x in got.collect()) == +many
    assert max(Counter(tuple(x) for x in got.collect()).values()) <= 2
    assert sorted(map(str, got.collect())) == sorted(map(str, mixing.repeat(df.repartition(7)).collect())) or any(k[0] == 1 for k in many)


def test_warc(spark, tmp_path):
    big = "é" * 600
    pages = spark.createDataFrame([(1, "http://www.a.example.org/x?b=1", big), (2, None, big), (3, "https://b.example.org/\r\n1", None), (5, "http://a.example.org/x?b=1", big), (6, "", "small"), (7, "http://a.example.org:81/", "small"), (None, "http://c", big)], "page_id long, url string, html string")
    directory = warc.archive(spark, pages, f"file://{tmp_path}/warc")
    got = {r["page_id"]: r for r in warc.look_up(directory, pages, keep_payload=True).collect()}
    text = {1: big, 2: big, 3: "", 5: big, 6: "small", 7: "small", None: big}
    for i, t in text.items():
        b = t.encode()
        revisit = t == big and i != 5
        assert (got[i]["payload_bytes"], got[i]["payload_digest"], got[i]["record_type"], got[i]["refers_to"], got[i]["valid"]) == (len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", 5 if revisit else None, True)
        assert bytes(got[i]["payload"]) == (b"" if revisit else b)
    index = warc.CaptureIndex(directory.collect())
    assert sorted(f["WARC-Record-ID"] for f, _, _ in index.fetch("http://a.example.org/x?b=1")) == ["<urn:page:1>", "<urn:page:5>"]
    assert index.fetch("http://nowhere.example/") == []
    nothing = pages.where("false")
    assert warc.look_up(warc.archive(spark, nothing), pages).count() == 0 and warc.look_up(directory, nothing).count() == 0
    assert warc.look_up(directory, spark.createDataFrame([(1, "http://a.example.org/x?b=1"), (1, "http://a.example.org/x?b=1"), (1, "http://c"), (None, "http://c")], "page_id long, url string")).count() == 2


def test_look_ups_of_every_key_in_small_blocks(spark, tmp_path):
    r = random.Random(6)
    rows = [(i, f"http://h{r.randrange(5)}.example.org/{r.randrange(30)}", "x" * r.randrange(3000)) for i in range(400)] + [(399, "http://h1.example.org/1", "again"), (399, "http://h1.example.org/1", "again")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    directory = warc.build_index(warc.write_archives(pages, f"file://{tmp_path}/w/archive", archive_bytes=20_000), f"file://{tmp_path}/w/index", block_lines=3)
    got = warc.look_up(directory, pages, at_once=7, gap=100)
    assert sorted((r["page_id"], r["url"], r["payload_bytes"], r["valid"]) for r in got.collect()) == sorted((i, u, len(t), True) for i, u, t in rows)
    index = warc.CaptureIndex(directory.collect(), kept=1)
    for url in {u for _, u, _ in rows}:
        assert sorted(f["WARC-Record-ID"] for f, _, _ in index.fetch(url)) == sorted(f"<urn:page:{i}>" for i, u, _ in rows if u == url)


def test_pages_that_both_bitmaps_take_wrongly_are_not_lost(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BITMAP_BITS", 1)
    rows = [(i, "http://a/", f"{i % 7 if i < 40 else i}" * 1500) for i in range(80)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    monkeypatch.setattr(warc, "bitmap_marked", lambda df, bits, slot, flag: df.withColumn(flag, F.lit(True) if flag != "_maybe_top" else F.col("_id") >= 33))
    first = warc.look_up(warc.archive(spark, pages, f"file://{tmp_path}/all"), pages)
    monkeypatch.setattr(warc, "bitmap_marked", lambda df, bits, slot, flag: df.withColumn(flag, F.lit(True) if flag != "_maybe_top" else F.col("_id").between(33, 39)))
    second = warc.look_up(warc.archive(spark, pages, f"file://{tmp_path}/lost"), pages)
    want = sorted((i, len(t), "revisit" if i < 33 else "response", 33 + (i - 33) % 7 if i < 33 else None) for i, _, t in rows)
    for got in (first, second):
        assert sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got.collect()) == want


def candidates_of(text):
    """(position, candidate, before, near, after) by Python's own regular expressions."""
    import re

    words, out = re.split(secrets.BLANKS, text), []
    at = lambda i: words[i] if 0 <= i < len(words) else ""
    for i, w in enumerate(words):
        if len(w.encode()) < 8:
            continue
        near = f"{at(i - 2)} {at(i - 1)}"
        assigned = at(i - 1).endswith(("=", ":", '="', ':"', "='", ":'")) and re.search(secrets.TELLING, near)
        found = re.findall(secrets.CANDIDATE, w) + re.findall(secrets.ASSIGNED, w) + (re.findall(secrets.FOLLOWING, w) if assigned else [])
        out += [(i, c, w[: w.index(c)], near, at(i + 1)) for c in dict.fromkeys(found)]
    return out


def features_of(c, before, near, after, path):
    import re

    n, context = len(c), f"{near} {before}"
    return [n, len(re.findall(secrets.CHANGE, c)) / n, sum(x in "0123456789" for x in c) / n, len(re.findall("[A-Z]", c)) / n, len(re.findall("[^A-Za-z0-9]", c)) / n, float(bool(re.search(secrets.HEX, c))), len(set(c)) / n,
            1 - len(re.sub(secrets.dictionary_pattern(secrets.DICTIONARY), "", c)) / n, 1 - len(re.sub(secrets.SYLLABLE, "", c)) / n,
            float(bool(re.search(secrets.TELLING, context))), float(bool(re.search(secrets.HARMLESS, f"{context} {after}"))), float(bool(re.search(secrets.PATHS, path))), float(bool(re.search(secrets.ASSIGNS, context)))]


def test_secrets(spark, docs, empty):
    forest = secrets.default_forest(spark)
    found = secrets.labelled_findings(720, seed=99)
    rows = [(i, f"intro {near} {before}{c}\" {after} end", path) for i, (before, near, c, after, path, *_) in enumerate(found)]
    rows += [(1000, 'password = "P@ss.w0rd!9x" and token:abcdefg1 {"api_key":"Zq8!kk#21"} auth: x', "app.py"), (1001, None, None), (1002, "", "a"), (1003, "x" * 20000 + " secret=" + "7f" * 20, "b"), (1004, "Größe=" + "ü" * 30 + "aB3" * 7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["findings"] for r in secrets.scan(df, forest).collect()}
    for i, t, path in rows:
        want = candidates_of(t or "")
        assert [(f["position"], f["candidate"]) for f in got[i]] == [w[:2] for w in want]
        for f, (_, c, before, near, after) in zip(got[i], want, strict=True):
            score = forest.predict(features_of(c, before, near, after, path or ""))
            assert f["score"] == pytest.approx(score, abs=1e-5) and f["secret"] == (score >= 0.5)
    assert [f["candidate"] for f in got[1000]] == ["P@ss.w0rd!9x", "abcdefg1", "Zq8!kk#21"] and got[1001] == got[1002] == []
    right = Counter()
    for i, (_, _, c, _, _, label, kind) in enumerate(found):
        right[kind] += any(f["secret"] for f in got[i] if f["candidate"] in c) == bool(label)
    assert min(right[k] / 40 for k in secrets.SECRET_KINDS) > 0.85 and sum(right.values()) / len(found) > 0.95
    small = secrets.Forest([(0, 1.5, 0.25, (2, 0.0, 1.0, 0.5)), 0.75])
    names = [f"f{k}" for k in range(3)]
    values = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, 0.0, 0.0), (2.0, 0.0, 1.0)], ", ".join(f"{n} double" for n in names))
    assert [r[3] for r in values.select("*", small.column([F.col(n) for n in names])).collect()] == [small.predict([1, 2, 3]), small.predict([2, 0, 0]), small.predict([2, 0, 1])]
    assert secrets.scan(docs, forest).where("findings is null").count() == 0 and secrets.scan(empty, forest).count() == 0


def test_secrets_planted_in_documents_are_found_and_prose_is_left_alone(spark):
    """The planted tokens of 40 hex digits, in either case, and nothing else."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    import re

    found = [f for r in secrets.scan(rows, secrets.default_forest(spark)).collect() for f in r["findings"]]
    is_hex = lambda c: re.fullmatch("[0-9a-f]{40}|[0-9A-F]{40}", c) is not None
    assert [f["candidate"] for f in found if f["secret"]] == [f["candidate"] for f in found if is_hex(f["candidate"])] and sum(f["secret"] for f in found) > 5


def test_toxicity(spark, docs, empty):
    r = random.Random(8)
    clean = [" ".join(r.choices(["alpha", "beta", "gamma", "delta", "epsilon", "zeta"], k=r.randint(5, 80))) for _ in range(300)]
    toxic = [c + " " + " ".join(r.choices(["vile", "rotten", "nasty"], k=1 + k % 8)) for k, c in enumerate(clean[:80])]
    model = toxicity.fit([*clean, *toxic], [0] * 300 + [1] * 80)
    p = model.severity(np.array([model.margin(t) for t in (clean[0], toxic[0], toxic[7], "")]))
    assert (p[:, 1] <= p[:, 0]).all() and p[0, 0] < 0.2 < 0.8 < p[2, 0] and p[2].sum() > p[1].sum()
    scored = toxicity.score(docs, model)
    assert scored.count() == docs.count() and scored.where("severity < 0 or severity > 2 or severity is null").count() == 0
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == scored.where("not toxic").count()
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.fit(["a"], [0]).severity(np.array([0.0]))[0, 0] < 0.01 and toxicity.fit(["a"], [1]).severity(np.array([0.0]))[0, 0] > 0.99


def test_length_does_not_hide_toxic_text(spark):
    r = random.Random(9)
    calm, insults = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"], ["vile", "rotten", "nasty"]
    make = lambda n: " ".join(r.choices(calm, k=n))
    clean = [make(r.randint(5, 400)) for _ in range(300)]
    toxic = [" ".join(r.choices(calm * 4 + insults, k=r.randint(20, 200))) for _ in range(80)]
    model = toxicity.fit([*clean, *toxic], [0] * 300 + [1] * 80)
    passage = " ".join(r.choices(calm + insults, k=60))
    rude = [" ".join(r.choices(calm * 30 + insults, k=n)) for n in (2000, 20000, 60000)]
    rude += [make(before) + " " + passage + " " + make(after) for before, after in ((9000, 9000), (0, 20000), (20017, 0), (60001, 5))]
    rows = [(i, t, i < len(rude)) for i, t in enumerate([*rude, *map(make, (2000, 20000, 60000))])]
    own = spark.createDataFrame(rows, "doc_id long, text string, want boolean")
    assert {r["doc_id"]: r["toxic"] for r in toxicity.score(own, model).collect()} == {i: want for i, _, want in rows}
    assert {r["doc_id"] for r in toxicity.keep_clean(own, model).collect()} == {i for i, _, want in rows if not want}
    assert toxicity.windows_of(0) == [(0, 0)] and toxicity.windows_of(64) == [(0, 64)] and toxicity.windows_of(130) == [(0, 64), (32, 96), (64, 128), (96, 130)]


def test_margins_and_severity_against_plain_python(spark, rows):
    import re
    from math import exp, sqrt

    r = random.Random(3)
    calm, insults = ["alpha", "beta", "gamma", "delta", "Größe", "zetalong"], ["vile", "rottenness", "nasty"]
    texts = [" ".join(r.choices(calm, k=r.randint(1, 150))) for _ in range(150)] + [" ".join(r.choices(calm * 2 + insults, k=r.randint(10, 150))) for _ in range(60)]
    model = toxicity.fit(texts, [0] * 150 + [1] * 60)
    own = [(i, t) for i, t, *_ in rows] + [(1000 + i, t) for i, t in enumerate(texts)]
    got = {x["doc_id"]: x for x in toxicity.score(spark.createDataFrame(own, "doc_id long, text string"), model).collect()}
    for i, t in own:
        words = re.findall(rb"[a-z\x80-\xff]+", (t or "").encode().lower())
        sums = []
        for lo in range(0, max(1, len(words) - 32), 32):
            total = 0.0
            for w, c in Counter(words[lo : lo + 64]).items():
                parts = [w, *(w[:k] + b"*" for k in (6, 7, 8, 9) if len(w) > k)]
                total += sqrt(c) * sum(model.weights.get(p, 0.0) for p in parts)
            sums.append(total)
        p = [1 / (1 + exp(-max(-50, min(50, max(sums) - cut)))) for cut in model.cuts]
        assert got[i]["margin"] == pytest.approx(max(sums), abs=1e-9) and got[i]["severity"] == pytest.approx(sum(p), abs=1e-9) and got[i]["toxic"] == (p[0] >= toxicity.THRESHOLD)


def test_toxicity_on_labelled_documents_that_were_not_learnt_from(spark):
    docs1, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_on(docs1, labels.where("doc_id % 2 = 0"))
    rows = toxicity.score(docs1.where("doc_id % 2 = 1"), model).join(labels.where("toxic is not null"), "doc_id").select(labels["toxic"].alias("want"), "severity", "p_mild").collect()
    said = [r["p_mild"] >= toxicity.THRESHOLD for r in rows]
    toxic = [s for r, s in zip(rows, said, strict=True) if r["want"]]
    clean = [s for r, s in zip(rows, said, strict=True) if not r["want"]]
    assert sum(toxic) / len(toxic) > 0.9 and sum(clean) / len(clean) < 0.005 and len(toxic) > 100


def test_long_labelled_texts_are_judged_but_not_learnt_from(spark):
    docs = spark.createDataFrame([(i, "calm words here" if i % 4 else "vile words here", "x") for i in range(80)] + [(100, "novel " * 100000, "x"), (None, "vile words here", "x")], "doc_id long, text string, _text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)] + [(100, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit_on(docs, labels)
    assert b"novel" not in model.weights and model.weights.get(b"vile", 0) > 0
    assert {r["doc_id"] for r in toxicity.score(docs, model).where("toxic and not doc_id <=> 100").collect()} == {None, *range(0, 80, 4)}


def test_quality_against_plain_python(spark, rows):
    import re

    def features(part, seen):
        n = len(part)
        coarse = lambda b: 0 if 97 <= b < 123 else 1 if 65 <= b < 91 else 2 if 48 <= b < 58 else 3 if b == 32 else 4 if b == 10 else 5 if 128 <= b < 192 else 6 if b >= 192 else 9 if b in b".," else 8 if b in quality._MARKS else 7
        return n, [coarse(b) for b in part]

    text = "Some words, a LINE\n" * 70 + "Größe 12 \x01 end. " * 9
    data = text.encode()
    got = quality.passages(text)
    assert len(got) == -(-len(data) // 512) and re.match("Some", text)
    for k in range(len(got)):
        part = data[512 * k : 512 * k + 512]
        n, kinds = features(part, None)
        pairs = Counter(zip(kinds, features(data[512 * k : 512 * k + 513], None)[1][1:], strict=False))
        for (a, b), c in pairs.items():
            assert got[k, quality.N_CLASSES + a * quality.N_COARSE + b] == pytest.approx(c / n, abs=1e-6)
        assert got[k, 0] == pytest.approx(sum(97 <= b < 123 for b in part) / n, abs=1e-6) and got[k, -1] == pytest.approx(n / 512)
        again = sum(data.find(data[s : s + 8]) < s for s in range(512 * k, min(512 * k + 512, len(data) - 7)))
        assert got[k, -2] == pytest.approx(again / n, abs=1e-6)
    long = quality.passages(text * 1500)
    assert len(long) == -(-len(data) * 1500 // 512) and np.isfinite(long).all()
    r = np.random.default_rng(1)
    shapes = {"W": (quality.N_FEATURES, 5), "b": (5,), "V": (5, 3), "U": (5, 3), "w": (3,), "c": (5,), "d": (1,)}
    model = quality.AttentionModel(r.normal(size=quality.N_FEATURES), r.uniform(0.5, 2, quality.N_FEATURES), {k: r.normal(0, 0.3, v) for k, v in shapes.items()})
    q, want = model.params, []
    for _, t, *_ in rows:
        x = (quality.passages(t or "") - model.mean) / model.scale
        h = np.tanh(x @ q["W"] + q["b"])
        e = np.array([sum(q["w"][j] * np.tanh(v @ q["V"][:, j]) / (1 + np.exp(-(v @ q["U"][:, j]))) for j in range(3)) for v in h])
        a = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
        want.append(1 / (1 + np.exp(-((a[:, None] * h).sum(0) @ q["c"] + q["d"][0]))))
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    scored = {x["doc_id"]: x for x in quality.score(df, model, block=7).collect()}
    assert [scored[r[0]]["score"] for r in rows] == pytest.approx(want, abs=1e-5)


def test_quality(spark, docs, empty):
    docs1, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_on(docs1, labels)
    rows = quality.score(docs1, model).join(labels, "doc_id").where("held_out and quality is not null").select("predicted", "quality").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.95
    got = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items()) and len(got) == docs.count()
    assert quality.score(empty, model).count() == 0
    x = np.concatenate([quality.passages(t) for t in ("", "A b!! " * 300)])
    f = quality._forward(model.params, (x - model.mean) / model.scale, np.array([0] + [1] * (len(x) - 1)), 2)
    assert np.bincount([0] + [1] * (len(x) - 1), f["a"]) == pytest.approx([1, 1])
    assert quality.fit([], []).scores([quality.passages("q")])[0] == pytest.approx(0.5)


def test_batches_are_bounded_by_bytes(spark):
    """Long texts reach Python in several batches, whole and in order; a bound that the session has stays."""
    from trajlake.llm.common import BATCH_BYTES, BATCH_KEY, map_batches

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "bytes"])

    texts = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    before = spark.conf.get(BATCH_KEY, None)
    try:
        spark.conf.unset(BATCH_KEY)
        got = map_batches(texts, sizes, "n long, bytes long").collect()
        assert sum(r["n"] for r in got) == 40 and len(got) >= 8 and max(r["bytes"] for r in got) <= BATCH_BYTES + (2 << 20)
        spark.conf.set(BATCH_KEY, 32 << 20)
        assert len(map_batches(texts, sizes, "n long, bytes long").collect()) < len(got) and spark.conf.get(BATCH_KEY) == str(32 << 20)
    finally:
        spark.conf.unset(BATCH_KEY)
        if before is not None:
            spark.conf.set(BATCH_KEY, before)
