import corpus_pipeline as c

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = out.cache()
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] > 0
    pieces = c.STAGES[-1][1](spark, docs, SF)
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").distinct().collect()}
    whole = c.run(spark, SF)
    assert whole.columns == pieces.columns and whole.agg({"length": "sum"}).first()[0] == pieces.agg({"length": "sum"}).first()[0]


def test_each_stage_against_brute_force(spark):
    from collections import Counter
    from math import exp

    from pyspark.sql import functions as F

    from trajlake.llm import mixing, packing, toxicity
    from trajlake.llm.queries import tokenizer_path

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    first = docs.orderBy("doc_id").limit(60).collect()
    long = max((r["text"] or "" for r in first), key=len)
    extra = [(9001, long.upper()), (9002, long + " one word more"), (9003, None), (9003, None), (9004, first[0]["text"])]
    fields = [f.name for f in docs.schema.fields]
    rows = [tuple(r) for r in first] + [tuple({"doc_id": i, "text": t, "lang": "en", "source": "z", "n_chars": 0}[k] for k in fields) for i, t in extra]
    now = spark.createDataFrame(rows, docs.schema)
    stages = dict(c.STAGES)
    held = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())

    model = toxicity.fit_on(docs, labels)
    want = Counter((r["doc_id"], r["text"]) for r in now.collect() if 1 / (1 + exp(model.cuts[0] - model.margin(r["text"] or ""))) < toxicity.THRESHOLD)
    now = stages["toxicity"](spark, now, SF).cache()
    assert held(now) == want and sum(want.values()) < len(rows)

    top = {}
    for i, t in want:
        key = (t or "").encode().lower()
        top[key] = max(top.get(key, (i, t)), (i, t), key=lambda x: x[0])
    now = stages["exact dedup"](spark, now, SF).cache()
    assert held(now) == Counter(top.values())

    sets = {}
    for i, t in top.values():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    group = {i: i for i in sets}
    for _ in range(len(sets)):
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    now = stages["near dedup"](spark, now, SF).cache()
    assert held(now) == Counter(x for x in top.values() if group[x[0]] == x[0]) and now.count() < len(top)

    times = Counter({r["doc_id"]: r["times"] for r in mixing.mix(now).collect()})
    now = stages["mix"](spark, now, SF).cache()
    assert Counter(i for i, _ in held(now).elements()) == +times and max(times.values()) <= 2

    ids = packing.BpeIds(tokenizer_path())
    tokens = Counter()
    for (i, t), n in held(now).items():
        tokens[i] += n * (len(ids(t or "")) + 1)
    pieces = stages["pack"](spark, now, SF)
    assert {r["doc_id"]: r["n"] for r in pieces.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == dict(tokens)
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
