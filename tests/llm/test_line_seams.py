"""Repeated passages of any length, wherever chunk boundaries fall."""

import random

from spotflow.llm.line_dedup import line_dedup


def repeated(rows):
    """Places (0 first) of lines in runs of two or more non-blank lines that a document before has."""
    first, gone = {}, {i: set() for i, _ in rows}
    for i, text in sorted(rows):
        lines = text.split("\n")
        full = [k for k, x in enumerate(lines) if x.strip(" ")]
        for a, b in zip(full, full[1:]):
            at = first.setdefault(tuple(lines[a:b + 1]), (i, b))
            if at[0] < i or at[1] < a:
                gone[i].update(range(a, b + 1))
    return gone


def test_every_repeated_pair_of_lines_goes(spark):
    rng = random.Random(11)
    pool = [f"pool {k} " + "z" * (k % 5) for k in range(400)]
    rows = []
    for i in range(60):
        parts = [f"own {i} {k}" for k in range(6)] + [""]
        for _ in range(3):  # passages of two to seven lines, with blank lines inside
            a = rng.randrange(390)
            passage = pool[a:a + rng.randrange(2, 8)]
            if rng.random() < 0.3:
                passage.insert(1, " ")
            at = rng.randrange(len(parts))
            parts[at:at] = passage
        rows.append((i, "\n".join(parts)))
    rows += [(70, "a\na\na"), (71, "b\nb\nb\nb"), (72, "c\n\n \nd"), (73, "e\nc\n\n \nd"), (74, "\n\n"), (75, "x\n"), (76, "c\n\nd")]
    want = repeated(rows)
    assert want[70] == set() and want[71] == {2, 3} and want[73] == {1, 2, 3, 4} and want[76] == set()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup(docs, seams=True).collect()}
    for i, text in rows:
        lines = text.split("\n")
        kept = got[i].kept_text.split("\n") if got[i].n_removed < len(lines) else []
        left = [x for k, x in enumerate(lines) if k not in want[i]]
        # chunks may take blank lines at their ends too
        assert [x for x in kept if x.strip()] == [x for x in left if x.strip()], i
        assert got[i].n_lines == len(lines) and got[i].n_removed == len(lines) - len(kept)
    chunks_only = sum(r.n_removed for r in line_dedup(docs).collect())
    assert sum(map(len, want.values())) > 1.5 * chunks_only
