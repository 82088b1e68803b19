"""Exact, near, substring and line dedup against brute force, and on awkward rows."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spotflow.llm import exact_dedup, line_dedup, simhash
from spotflow.llm.substring_dedup import substring_dedup


def table(spark, rows, extra=""):
    return spark.createDataFrame(rows, f"doc_id long, text string{extra}")


@pytest.fixture(scope="module")
def awkward():
    """Nulls, empty and long texts, ties, repeated rows, white space of all kinds."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    passage = " ".join(rng.choice(words) for _ in range(70))
    long = " ".join(rng.choice(words) for _ in range(30_000))
    return [
        (None, passage), (None, None), (1, None), (2, ""), (3, "one"), (4, long), (5, "x " * 30 + passage), (6, passage.replace(" ", "\n")),
        (7, passage + "\t" + passage), (7, passage), (7, passage), (8, "É" + passage), (9, "a b\x1cc " * 40), (10, "a b\x1cc " * 40 + "!"),
        (11, long[:100_000] + " " + passage), (12, "\n\n\n"), (13, "A B"), (14, "a b"), (-3, "\U0001f600 " * 80), (-2, "\U0001f600 " * 79),
    ]


def cut_out(rows, window):
    """Substring dedup as a loop."""
    key = lambda i: (i is not None, i or 0)
    words = [(key(i), (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            v = tuple(w[k:k + window])
            first[v] = min(first.get(v, i), i)
    out = []
    for (i, w), (doc_id, _) in zip(words, rows):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < i:
                gone[k:k + window] = [True] * window
        out.append((doc_id, b" ".join(x for x, g in zip(w, gone) if not g).decode(), len(w), sum(gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window, buckets", [(50, None), (3, 1)])
def test_substrings_equal_the_loop(spark, awkward, window, buckets):
    got = substring_dedup(table(spark, awkward).repartition(3), window, buckets)
    rows = [(r.doc_id, r.kept_text, r.n_words, r.n_removed) for r in got.collect()]
    assert sorted(rows, key=repr) == cut_out(awkward, window)
    for r in got.collect():
        spans = [(x["from"], x["to"]) for x in r.removed]
        assert sum(b - a for a, b in spans) == r.n_removed and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_substrings_in_many_blocks(spark, awkward, monkeypatch):
    from spotflow.llm import substring_dedup as module

    monkeypatch.setattr(module, "blocked", lambda docs, chars: docs.withColumn("_block", F.coalesce(F.col("doc_id") + 3, F.lit(0)).cast("int")))
    got = [(r.doc_id, r.kept_text, r.n_words, r.n_removed) for r in module.substring_dedup(table(spark, awkward), 5).collect()]
    assert sorted(got, key=repr) == cut_out(awkward, 5)


def test_empty_tables(spark, tmp_path):
    none = table(spark, [])
    assert substring_dedup(none).count() == 0 and line_dedup.line_dedup(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0
    index = exact_dedup.DigestIndex(spark, "digests_empty", 2, str(tmp_path / "index"))
    assert index.decide(none, "a").count() == 0 and index.keep(none, "b").count() == 0


def test_exact_dedup_keeps_the_largest_id(spark, awkward, tmp_path):
    docs = table(spark, [(i, t, i, "x") for i, t in awkward], ", digest long, `row` string")
    index = exact_dedup.DigestIndex(spark, "digests_one", 3, str(tmp_path / "index"))
    got = index.decide(docs, "a").collect()
    lower = lambda t: (t or "").encode().lower()
    groups = {}
    for i, t in awkward:
        groups.setdefault(lower(t), []).append(i)
    assert len(got) == len(awkward)
    top = {k: max((i for i in v if i is not None), default=None) for k, v in groups.items()}
    want = sorted(((i, top[lower(t)], len(groups[lower(t)])) for i, t in awkward), key=repr)
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=repr) == want
    assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)
    again = {(r.doc_id, r.text_sha256): r.kept for r in index.decide(docs, "a").collect()}
    assert again.items() >= {(r.doc_id, r.text_sha256): True for r in got if r.kept}.items()
    fresh = exact_dedup.DigestIndex(spark, "digests_two", 3, str(tmp_path / "other"))
    kept = fresh.keep(docs, "a")
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_exact_dedup_against_earlier_batches(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, "digests_three", 2, str(tmp_path / "index"))
    index.decide(table(spark, [(1, "Aa"), (2, "b")]), "monday").collect()
    got = {r.doc_id: (r.keep_id, r.kept) for r in index.decide(table(spark, [(3, "aA"), (4, "c"), (5, "Ä"), (6, "ä")]), "tuesday").collect()}
    assert got == {3: (1, False), 4: (4, True), 5: (5, True), 6: (6, True)}
    assert index.rows().count() == 5
    assert [r.doc_id for r in index.keep(table(spark, [(7, "B"), (8, "d")]), "wednesday").collect()] == [8]


def brute_components(rows, radius=3):
    prints = [simhash.fingerprint((t or "").encode(), 3) for _, t in rows]
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = part[i], part[j]
                part = [b if p == a else p for p in part]
    least = {}
    for (i, _), p in zip(rows, part):
        least[p] = min((x for x in (least.get(p), i) if x is not None), default=None)
    return sorted(((i, p if p < 1 << 63 else p - (1 << 64), least[c]) for (i, _), p, c in zip(rows, prints, part)), key=repr)


def test_fingerprint_by_its_definition():
    words = "The cat sat on the Mat É the cat sat on".split()
    hashes = [xxhash.xxh64_intdigest(" ".join(w.lower() if w.isascii() else w for w in words[i:i + 3]), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(" ".join(words).encode(), 3) == want
    assert simhash.fingerprint(b" \t", 3) == 0 and simhash.fingerprint(b"Two WORDS", 3) == xxhash.xxh64_intdigest("two words", 42)


def test_near_duplicates_equal_all_pairs(spark, awkward):
    rng = random.Random(3)
    base = [f"t{rng.randrange(500)}" for _ in range(800)]
    near = [(100 + k, " ".join(["changed" if rng.random() < k / 4000 else w for w in base])) for k in range(40)]
    rows = awkward + near
    got = simhash.near_duplicates(table(spark, rows)).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=repr) == brute_components(rows)
    kept = [r.doc_id for r in simhash.keep_one(table(spark, [(i, t, 1) for i, t in rows], ", _d int")).collect()]
    assert sorted(set(kept), key=repr) == sorted({c for _, _, c in brute_components(rows)}, key=repr)


def test_large_buckets_are_divided(spark):
    rng = np.random.default_rng(0)
    base = int(rng.integers(0, 1 << 63))
    values = {base}
    for _ in range(300):
        x = base
        for b in rng.integers(0, 64, int(rng.integers(0, 6))):
            x ^= 1 << int(b)
        values.add(x)
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    edges = simhash.links(spark.createDataFrame([(v, v) for v in signed], "id long, fingerprint long"), 3, 16).collect()
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in edges)

    def classes(pairs):
        of = {v: v for v in signed}
        for a, b in pairs:
            if of[a] != of[b]:
                old, new = of[a], of[b]
                of = {v: new if c == old else c for v, c in of.items()}
        groups = {}
        for v, c in of.items():
            groups.setdefault(c, set()).add(v)
        return sorted(map(sorted, groups.values()))

    near = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    assert classes(map(tuple, edges)) == classes(near)


def brute_lines(rows, mean=3):
    def h(b):
        return xxhash.xxh64_intdigest(b, 42)

    found, first = [], {}
    for i, t in rows:
        text = t or ""
        of_text = h(text.encode())
        of_text -= (1 << 64) * (of_text >> 63)
        lines = text.split("\n")
        hashes, start = [h(x.encode()) for x in lines], 0
        for k in range(len(lines)):
            before = hashes[k - 1] if k else 0
            rolled = ((before << 1 | before >> 63) & (1 << 64) - 1) ^ hashes[k]
            mixed = h(rolled.to_bytes(8, "little"))
            if k == len(lines) - 1 or (mixed - (1 << 64) * (mixed >> 63)) % mean == 0:
                chunk = lines[start:k + 1]
                if sum(x.strip(" ") != "" for x in chunk) > 1:
                    place = (i is not None, i or 0, of_text, start)
                    found.append(((i, text), "\n".join(chunk), place, range(start, k + 1)))
                    first[found[-1][1]] = min(first.get(found[-1][1], place), place)
                start = k + 1
    gone = {}
    for doc, chunk, place, span in found:
        if place > first[chunk]:
            gone.setdefault(doc, set()).update(span)
    out = []
    for i, t in rows:
        text = t or ""
        lines = text.split("\n")
        g = gone.get((i, text), set())
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in g), len(lines) if text else 0, len(g)))
    return sorted(out, key=repr)


def test_line_chunks_equal_the_loop(spark, awkward):
    rng = random.Random(9)
    lines = [f"line {i} " + "z" * (i % 7) for i in range(40)]
    shared = "\n".join(lines[:25])
    rows = awkward + [(50 + k, "\n".join(rng.choice(lines) for _ in range(k)) + "\n" + shared + "\nend " + str(k)) for k in range(20)]
    got = [(r.doc_id, r.kept_text, r.n_lines, r.n_removed) for r in line_dedup.line_dedup(table(spark, rows)).collect()]
    want = brute_lines(rows)
    assert sorted(got, key=repr) == want and sum(w[3] for w in want) > 200
