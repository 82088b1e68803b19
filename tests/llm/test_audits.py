"""Source divergence, filter interaction and the pivot index against plain loops."""

import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotflow.llm import filter_interaction, pivot_index, source_divergence

# -- source divergence ----------------------------------------------------------------


def brute_divergence(rows, min_df, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))) for text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = {}
        for _, _, ts in mine:
            for t in set(ts):
                df[t] = df.get(t, 0) + 1
        kept = [t for t, n in df.items() if n >= min_df]
        v = len(kept)

        def counts(ds):
            got = dict.fromkeys(kept, 0)
            for _, _, ts in ds:
                for t in ts:
                    if t in got:
                        got[t] += 1
            return got

        def shares(c):
            n = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * v) for t in kept}

        by = {s: counts([d for d in mine if d[1] == s]) for s in {d[1] for d in mine}}
        p, q = {s: shares(c) for s, c in by.items()}, shares(counts(mine))
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in by:
            pairs = [(sum(gap(p[s][t], p[o][t]) for t in kept), o) for o in by if o != s]
            own = [(gap(p[s][t], q[t]), t) for t in kept if by[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", own, top)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


@pytest.mark.parametrize("sizes", [{}, {"bucket_terms": 5, "block_sources": 2}])
def test_divergence_is_that_of_a_loop(spark, sizes):
    rnd = random.Random(3)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["Straße", "ÉCOLE", "数据", "x y"]
    rows = []
    for i in range(300):
        n = rnd.choice([0, 1, 5, 30])
        text = " ".join(rnd.choices(words, k=n)).replace("wa", rnd.choice(["wa", "WA", "w4a", "wa'"]))
        rows.append((rnd.choice([text, text, None, ""]), rnd.choice(["en", "de", None, "en"]), rnd.choice(["a", "b", "c", "Ä", None, "d"])))
    rows += [("only once", "one", "alone"), ("--- 123", "rare", "a"), (None, "rare", "b"), ("x" * 100_000, "rare", "b")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("term", F.lit(1)).withColumn("n", F.lit("x"))
    got = source_divergence.divergence(docs, min_df=4, top=3, **sizes)
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found))
    assert set(found) == brute_divergence(rows, 4, 3)


def test_sums_given_back_in_parts_add_up(spark):
    docs = spark.createDataFrame([(f"t{chr(97 + i % 7)} u", "en", "s") for i in range(200)], "text string, lang string, source string")
    whole, parts = (sorted(map(tuple, source_divergence.group_sums(docs, m).collect()), key=str) for m in (1 << 19, 1))
    assert whole == parts


def test_share_is_exact_beyond_a_long(spark):
    big = 3_000_000_000_000
    row = spark.range(1).select(source_divergence.share(F.lit(big), F.lit(7 * big + 1), F.lit(11)).alias("p")).first()
    assert row.p == 1 + 10**9 * (big + 2) // (7 * big + 1 + 22)


def test_no_documents_no_divergence(spark):
    assert source_divergence.divergence(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


# -- filter interaction ---------------------------------------------------------------


def fails(i, rows):
    doc_id, text, _ = rows[i]
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    return {
        "A": len(words) < 100,
        "B": 100 * len(set(words)) < 80 * len(words),
        "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
        "D": bool(re.search("[#$%&*|]", t)),
        "E": doc_id is not None and any(o is not None and o < doc_id and (x or "") == t for o, x, _ in rows),
    }


def test_interaction_is_that_of_filters_run_in_turn(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(60):
        n, pool = rnd.choice([0, 20, 100, 130]), rnd.choice([3, 1000])
        text = " ".join(rnd.choice(["Word", "word", "é", "WORD"]) + str(rnd.randrange(pool)) for _ in range(n)) + rnd.choice(["", " #", " |"])
        rows.append((rnd.choice([i, i, None, 7]), rnd.choice([text, None, "same copy"]), rnd.choice(["en", None, ""])))
    rows += [(100 + i, "A long text " * 500, "fr") for i in range(5)]
    labels = [(i, i % 2, None if i % 5 else 1) for i in range(0, 110)] + [(7, 0, 1), (None, 1, 1), (8, 1, 0)]
    good, toxic = ({d for d, q, x in labels if d is not None and v(q, x)} for v in (lambda q, x: q == 1, lambda q, x: x == 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("part", F.lit(0)).withColumn("lo", F.lit(1)).repartition(5)
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_interaction.audit(
        docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("mask", F.lit(1))).collect()}
    masks = [fails(i, rows) for i in range(len(rows))]
    want, shapley = {}, {}
    for part in {r[2] or "" for r in rows}:
        mine = [i for i, r in enumerate(rows) if (r[2] or "") == part]
        for order in map("".join, permutations("ABCDE")):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [i for i in left if masks[i][f]]
                left = [i for i in left if not masks[i][f]]
                redundant = sum(masks[i][f] for i in mine) - len(gone)
                unique = sum(masks[i][f] and sum(masks[i].values()) == 1 for i in mine)
                want[part, order, step] = (len(left), len(gone), redundant, unique, sum(rows[i][0] in good for i in gone), sum(rows[i][0] in toxic for i in gone))
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    assert got == {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in want.items()}


def test_ranks_are_a_min_plus_product():
    orders, ranks = filter_interaction.removal_ranks(4)
    for m in range(16):
        for o, r in zip(orders.tolist(), ranks[m]):
            assert r == min([o.index(f) for f in range(4) if m >> f & 1], default=4)


def test_no_documents_no_interaction(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_interaction.audit(docs, labels).count() == 0


# -- pivot index ----------------------------------------------------------------------


def brute_links(rows, cosine):
    ok = [i for i, (_, e, label) in enumerate(rows) if label is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    near = {i: set() for i in range(len(rows))}
    for label, dim in {(rows[i][2], len(rows[i][1])) for i in ok}:
        at = [i for i in ok if rows[i][2] == label and len(rows[i][1]) == dim]
        x = pivot_index.unit(np.array([rows[i][1] for i in at], np.float64))
        for a, b in np.argwhere(x @ x.T >= cosine):
            if a != b:
                near[at[a]].add(at[b])
    out = []
    for i in range(len(rows)):
        seen, front = {i}, [i]
        while front:
            front = [b for a in front for b in near[a] if b not in seen and not seen.add(b)]
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        least = min(ids) if ids else None
        out.append((rows[i][0], len(near[i]), least, rows[i][0] == least))
    return out


def vectors(seed, n=400, dense=250, dim=32):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=dim).astype(np.float32).tolist(), int(rng.integers(3))) for i in range(n)]
    centre = rng.normal(size=dim)  # a third of all: near copies of one vector, not all within the limit
    rows += [(1000 + i, (centre + 0.13 * rng.normal(size=dim)).astype(np.float32).tolist(), 1) for i in range(dense)]
    for i in range(0, n, 9):  # pairs and chains just around the limit
        v = np.array(rows[i][1])
        for k in range(3):
            v = v + rng.choice([0.1, 0.19, 0.22]) * rng.normal(size=dim)
            rows.append((2000 + 3 * i + k, v.astype(np.float32).tolist(), rows[i][2]))
    rows += [(5000 + i, rows[3][1], rows[3][2]) for i in range(40)]  # copies
    rows += [
        (None, rows[3][1], rows[3][2]), (3, rows[3][1], rows[3][2]), (6000, rows[5][1], None), (6001, None, 1), (6002, [], 1), (6003, [0.0] * dim, 1),
        (6004, [None] + [1.0] * (dim - 1), 1), (6005, [float("nan")] + [1.0] * (dim - 1), 1), (6006, [float("inf")] + [1.0] * (dim - 1), 1),
        (6007, [1.0, 2.0], 1), (6008, [1e-30, 2e-30], 1), (6009, [1e30, 2e30], 1), (None, [5.0], 2), (None, [7.0], 2), (6010, [-5.0], 2),
    ]
    return rows


@pytest.mark.parametrize("most", [4096, 40])
def test_links_are_those_of_all_pairs(spark, most):
    rows = vectors(most)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n", F.lit(1)).withColumn("cid", F.lit("x")).repartition(6)
    got = sorted(map(tuple, pivot_index.near_duplicates(df, most=most, n_pivots=128).collect()), key=str)
    want = sorted(brute_links(rows, 0.98), key=str)
    assert [r[0] for r in got] == [r[0] for r in want]
    # a search: nothing false, and at least 0.99 of all links
    found, links = sum(r[1] for r in got), sum(r[1] for r in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert found >= 0.99 * links
    assert sum(g[2:] == w[2:] for g, w in zip(got, want)) >= 0.99 * len(rows)


def test_all_candidates_make_the_search_exact(spark):
    """With one shared pivot of as many as there are, every pair of a label is a candidate."""
    rows = vectors(1, n=60, dense=60, dim=8)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = pivot_index.near_duplicates(df, n_pivots=16, prefix=16, shared=16, most=16)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_links(rows, 0.98), key=str)


def test_one_list_counts_what_belongs_to_it():
    rng = np.random.default_rng(0)
    ranks = np.sort(np.array([rng.choice(12, 5, replace=False) for _ in range(60)]), axis=1)
    x = pivot_index.unit(rng.normal(size=(60, 4)))
    total = np.zeros((60, 60), int)
    for p in range(12):
        at = np.flatnonzero((ranks[:, :3] == p).any(1))
        total[np.ix_(at, at)] += pivot_index.linked(ranks[at], x[at], np.arange(len(at)), np.arange(len(at)), True, p, 1, 3, 0.5, rows=7)
    share = np.array([[len(set(a) & set(b)) for b in ranks] for a in ranks])
    want = (share >= 3) & (x @ x.T >= 0.5) & ~np.eye(60, dtype=bool)
    assert (total == want).all()


def test_no_vectors(spark):
    assert pivot_index.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_every_document_makes_the_latent_space(spark):
    from spotflow.llm import decontaminate

    rare = [f"rare{i} word{i}" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(["common text"] * 8000 + rare)), "doc_id long, text string")
    hashed = decontaminate._hashed(docs)
    weights = decontaminate.inverse_frequencies(docs, hashed)
    space = decontaminate.latent_space(docs, [], weights)
    for text in ["common text", *rare]:  # of half of the documents, half of these would be unknown
        feature = decontaminate._features([text.encode()])[0]
        vector = (space[feature] * weights[feature][:, None]).sum(0)
        assert np.linalg.norm(vector) > 0.99 * np.linalg.norm(weights[feature])


def test_every_passage_is_in_the_sketch():
    from spotflow.llm import decontaminate

    rng = np.random.default_rng(3)
    feature, counts = rng.integers(0, 50, 3000), np.array([0, 1, 64, 65, 870, 2000])
    weights = rng.random(decontaminate.FEATURES)
    row, feature, value = decontaminate._passages(feature, counts, weights)
    matrix = np.zeros((row[-1] + 1, decontaminate.FEATURES))
    np.add.at(matrix, (row, feature), value)
    total = np.zeros((1 << 14, decontaminate.FEATURES), np.float32)  # rows enough that few passages meet
    decontaminate._sketch(feature, counts, weights, total)
    kept = total[np.abs(total).sum(1) > 0]
    assert len(kept) >= 3 * len(matrix) - 5
    assert np.isclose(np.abs(kept).sum(), 3 * np.abs(matrix).sum(), rtol=0.05)


def test_a_sketch_is_handed_in_part_by_part():
    from spotflow.llm import decontaminate

    total = np.random.default_rng(5).random((8, decontaminate.FEATURES)).astype(np.float32)
    parts = list(decontaminate._parts(total.reshape(-1), np.float32))
    assert max(b.num_rows for b in parts) == 1 and max(b.nbytes for b in parts) < total.nbytes / 50
    assert b"".join(b["values"][0].as_py() for b in parts) == total.tobytes()
    assert [b["part"][0].as_py() for b in parts] == list(range(len(parts)))


def test_a_worker_gives_back_what_earlier_tasks_freed():
    from spotflow.llm import common

    def used():
        return int(open("/proc/self/statm").read().split()[1]) * 4096

    common.release()
    before = used()
    made = [bytes(100_000) for _ in range(2000)]  # below the size from which memory is mapped by itself
    last = bytes(100_000)  # keeps the end of the heap in use
    del made
    common.powers(1 << 22)
    common.release()
    assert used() - before < 60e6 and last
