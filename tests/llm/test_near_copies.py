"""The near-duplicate stage of the pipeline against all pairs."""

import random

from pyspark.sql import functions as F

from spotflow.llm import near_copies, simhash
from spotflow.operators.graphs import connected_components


def brute(rows, radius=3):
    """The rows that stay, by all pairs of texts; a negative radius leaves Jaccard links alone."""
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets = [shingles(t) for _, t in rows]
    prints = [simhash.fingerprint((t or "").encode(), 3) for _, t in rows]
    part, far = list(range(len(rows))), 0
    for i in range(len(rows)):
        for j in range(i):
            like = 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
            near = (prints[i] ^ prints[j]).bit_count() <= radius
            far += like and not near
            if like or near:
                a, b = part[i], part[j]
                part = [b if p == a else p for p in part]
    best = {}
    for (i, t), p in zip(rows, part):
        place = (i is None, i or 0)
        best[p] = min(best.get(p, (place, i)), (place, i))
    return sorted((i for _, i in best.values()), key=repr), far


def test_stage_equals_all_pairs(spark):
    import corpus_pipeline

    rng = random.Random(4)
    rows = [(500, "a b c"), (501, "A  B c"), (502, "a b d"), (None, "x y z"), (None, "u v w x y z"), (503, "x Y z")]
    for group in range(40):  # changed words in each copy: similarities from 0.6 to 1
        base = [f"t{rng.randrange(3000)}" for _ in range(rng.randrange(80, 400))]
        for k in range(4):
            words = list(base)
            for _ in range(round(len(words) * k * rng.random() / 40)):
                words[rng.randrange(len(words))] = f"n{rng.randrange(3000)}"
            rows.append((4 * group + k, " ".join(words)))
    rng.shuffle(rows)
    want, far = brute(rows)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, _d int")
    got = corpus_pipeline.near(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((r.doc_id for r in got.collect()), key=repr) == want
    assert far > 20 and len(want) < simhash.keep_one(docs).count()


def test_stage_without_near_copies(spark):
    assert near_copies.keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(30))) for i in range(5)]
    assert near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).count() == 5


def test_large_bands_in_blocks(spark):
    """Bands cut into blocks give the links that whole bands give."""
    rng = random.Random(9)
    base = [f"t{k}" for k in range(300)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(12)):
            words[rng.randrange(300)] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    want, _ = brute(rows, -1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    signed = near_copies.signatures(docs)
    one = signed.select("key", F.explode("bands").alias("band"))
    sizes = one.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("least")).where("n > 1")
    texts = docs.withColumn("text_hash", F.xxhash64("text")).join(signed, ["doc_id", "text_hash"]).select("key", "text", "doc_id")
    shared, first = one.join(sizes, "band"), dict(texts.select("key", "doc_id").collect())
    found = []
    for most, spread in ((10**6, 16), (5000, 16), (5000, 2)):  # one block, blocks of the cluster, blocks of its bands
        classes = connected_components(near_copies.jaccard_links(shared, texts, most=most, spread=spread)).collect()
        found.append({(r.member, r.root) for r in classes})
    assert found[0] == found[1] == found[2] and found[0]
    groups = {}
    for member, root in found[0]:
        groups.setdefault(root, []).append(first[member])
    alone = set(first.values()) - {first[m] for m, _ in found[0]}
    assert want == sorted(alone | {min(g) for g in groups.values()}, key=repr)


def test_forest_connects_what_all_pairs_connect():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(60):
        sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40))) for _ in range(rng.integers(1, 25))]
        percent = int(rng.integers(20, 95))
        part = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    part = [part[j] if p == part[i] else p for p in part]
        one, two = near_copies.forest(np.cumsum([0, *map(len, sets)]), np.concatenate(sets), percent)
        got = list(range(len(sets)))
        for i, j in zip(one, two):
            assert 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j]))
            got = [got[j] if p == got[i] else p for p in got]
        same = lambda p: {(i, j) for i in range(len(p)) for j in range(i) if p[i] == p[j]}
        assert same(got) == same(part) and len(one) == len(sets) - len(set(part))


def test_forest_of_a_large_group_is_quick():
    """5,000 sets, no two of them linked, though each shares two thirds of its hashes with all others."""
    import time

    import numpy as np

    sets = np.concatenate([np.concatenate([np.arange(100), 1000 + 50 * i + np.arange(50)]) for i in range(5000)])
    began = time.time()
    assert near_copies.forest(np.arange(0, 150 * 5000 + 1, 150), sets, 80) == ([], [])
    assert time.time() - began < 60


def test_stages_leave_clashing_columns_alone(spark):
    import corpus_pipeline

    names = ["score", "lang_pred", "key", "root", "band", "least", "n", "block", "sketch", "_h", "ids", "decoded"]
    docs = [(i, f"Some words number {i} and a few more of them, enough to tell the language.", "en") for i in range(8)] + [(8, "123", "en")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    for name in names:
        df = df.withColumn(name, F.lit(7.0))
    kept = corpus_pipeline.language(spark, df, "")
    assert kept.columns == df.columns and kept.count() == 8
    for stage in (corpus_pipeline.exact, corpus_pipeline.near):
        kept = stage(spark, kept, "")
        assert kept.columns == df.columns and kept.count() == 8
    assert {tuple(r)[3:] for r in kept.collect()} == {(7.0,) * len(names)}


def test_documents_without_any_language_stay(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "words here", None), (2, None, None)], "doc_id long, text string, lang string")
    assert corpus_pipeline.language(spark, docs, "").count() == 2


def test_a_key_is_hooked_once_to_a_group(spark):
    from spotflow.llm.near_copies import hooked
    from spotflow.operators.graphs import connected_components

    rows = [(b, k, b % 3) for b in range(40) for k in range(200) if k >= b % 3] + [(90, 500, 300), (90, 300, 300), (91, 500, 2), (91, 2, 2), (92, 700, 600), (92, 600, 600)]
    shared = spark.createDataFrame(rows, "band long, key long, least long")
    edges = hooked(shared)
    assert edges.count() <= 200 + 10
    found = {r.member: r.root for r in connected_components(edges).collect()}
    assert found == {**{k: 0 for k in [*range(200), 300, 500]}, 600: 600, 700: 600}
