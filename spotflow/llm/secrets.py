"""Secret scans: fixed patterns, and character Markov models of random strings and of identifiers.

Positions come from cutting the text at the pattern: the lengths of the parts
between the matches and of the matches add up to code-point offsets.

A token is random or ordinary. Both are modelled as Markov chains over
characters, trained on labelled tokens: those that the fixed patterns mark as
secrets against ordinary words of the same documents. A token whose
log-likelihood ratio is high enough is a span of its own. All of it is built
from DataFrame functions; the two models become one table of 67 x 67 numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

#: Kind, pattern, group that must reach the length, least length.
KINDS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: Tokens that the models judge.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
WORD = r"[A-Za-z0-9+/_=-]{6,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Number of characters, and of the edge before the first.
SIZE = len(ALPHABET)
#: Matches of a text that are summed together.
BLOCK = 256


def _blocks(items: Column, size: int = BLOCK) -> Column:
    """An array cut into arrays of ``size`` elements at most; one empty array for an empty one."""
    return F.transform(F.array(items), lambda all_: F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.size(all_) / size).cast("int") - 1, F.lit(0))),
        lambda b: F.slice(all_, b * size + 1, F.lit(size)),
    ))[0]


def _starts(parts: Column) -> Column:
    """Starts of the matches, from (g, m): lengths of the part before each match and of the match, null after the last.

    Running sums within blocks, and over the blocks: appending to one list would copy it at each match.
    """
    ints = F.array().cast("array<int>")

    def sums(block: Column) -> Column:
        return F.aggregate(
            block, F.struct(F.lit(0).alias("at"), ints.alias("starts")),
            lambda acc, x: F.struct(
                (acc["at"] + x["g"] + F.coalesce(x["m"], F.lit(0))).alias("at"),
                F.when(x["m"].isNotNull(), F.concat(acc["starts"], F.array(acc["at"] + x["g"]))).otherwise(acc["starts"]).alias("starts"),
            ),
        )

    def joined(summed: Column) -> Column:
        offsets = F.aggregate(
            summed, F.struct(F.lit(0).alias("at"), ints.alias("offsets")),
            lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["offsets"], F.array(acc["at"])).alias("offsets")),
        )["offsets"]
        return F.flatten(F.zip_with(summed, offsets, lambda x, o: F.transform(x["starts"], lambda s: s + o)))

    return F.transform(F.array(F.transform(_blocks(parts), sums)), joined)[0]


def _free(tokens: Column, base: Column) -> Column:
    """Tokens that no base span overlaps; each block of tokens meets only the spans that reach into it."""
    def of_block(block: Column) -> Column:
        first, last = F.get(block, F.lit(0))["start"], F.element_at(block, -1)["end"]
        near = F.filter(base, lambda x: (x["start"] < last) & (first < x["end"]))
        return F.transform(F.array(near), lambda spans: F.filter(
            block, lambda t: ~F.exists(spans, lambda x: (x["start"] < t["end"]) & (t["start"] < x["end"]))
        ))[0]

    return F.flatten(F.transform(F.filter(_blocks(tokens), lambda b: F.size(b) > 0), of_block))


def _spans(text: Column, kind: str, pattern: str, keep) -> Column:
    """Leftmost non-overlapping matches as (start, end, kind, value); ``keep`` tests the matched string."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda s: F.char_length(s))
    lengths = F.transform(found, lambda s: F.char_length(s))
    start = _starts(F.arrays_zip(gaps.alias("g"), lengths.alias("m")))
    made = F.transform(
        F.arrays_zip(start.alias("s"), found.alias("v")),
        lambda x: F.struct(
            x["s"].alias("start"), (x["s"] + F.char_length(x["v"])).alias("end"), F.lit(kind).alias("kind"), x["v"].alias("value")
        ),
    )
    none = F.array().cast("array<struct<start: int, end: int, kind: string, value: string>>")
    return F.when(text.rlike(pattern), F.filter(made, lambda x: keep(x["value"]))).otherwise(none)


def _long_enough(pattern: str, group: int, least: int):
    return lambda v: F.char_length(F.regexp_extract(v, pattern, group)) >= least


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, by start and then by kind as listed."""
    parts = []
    for kind, pattern, group, least in KINDS:
        # a run of one class of characters: asking for its length finds the same matches
        fixed = pattern if group else f"{pattern[:-1]}{{{least - 4 if kind == 'access' else least},}}"
        parts.append(_spans(text, kind, fixed, _long_enough(pattern, group, least) if group else lambda v: F.lit(True)))
    return in_order(F.concat(*parts))


def in_order(spans: Column) -> Column:
    rank = F.create_map(*[F.lit(x) for i, k in enumerate([*[k for k, *_ in KINDS], "random"]) for x in (k, i)])
    keyed = F.transform(spans, lambda x: F.struct(x["start"].alias("a"), rank[x["kind"]].alias("b"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda x: x["x"])


def _codes(token: Column) -> Column:
    """Places of the characters in the alphabet, from 1."""
    return F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))


def transitions(tokens: DataFrame) -> DataFrame:
    """(token, random) → random, a, b, n: how often character b follows a; 0 stands before the first."""
    pairs = tokens.select("random", _codes(F.col("token")).alias("c")).select(
        "random", F.explode(F.arrays_zip(F.concat(F.array(F.lit(0)), F.col("c")).alias("a"), F.col("c").alias("b"))).alias("p")
    )
    return pairs.where("p.b is not null").groupBy("random", F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def labelled(docs: DataFrame, least_docs: int = 20_000) -> DataFrame:
    """(token, random): values of base spans, and words of other documents.

    Words are taken from about ``least_docs`` documents, chosen by a hash of
    doc_id; secrets are taken from all documents among these and have a label
    by the fixed patterns. Long tokens with digits that no pattern marks have
    no label: they are what the models will judge.
    """
    n = docs.count()
    modulus = max(1, n // least_docs)
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(modulus)) == 0)
    spans = some.select(F.coalesce("text", F.lit("")).alias("text")).select("text", base_spans(F.col("text")).alias("spans"))
    _, pattern, group, _ = KINDS[0]
    secret = spans.select(F.explode("spans").alias("x")).select(
        F.when(F.col("x.kind") == "assign", F.regexp_extract("x.value", pattern, group)).otherwise(F.col("x.value")).alias("token"),
        F.lit(True).alias("random"),
    ).where(F.length("token") >= 12)
    word = spans.where(F.size("spans") == 0).select(
        F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).alias("token"), F.lit(False).alias("random")
    ).where((F.length("token") < 20) | ~F.col("token").rlike("[0-9]"))
    return secret.union(word)


def train(docs: DataFrame, least_docs: int = 20_000, weight: float = 8.0) -> list[float]:
    """Log-likelihood ratios of all transitions (a, b) at a * (SIZE + 1) + b; 4,624 numbers.

    A transition's chance leans on how frequent its second character is, with
    the weight of ``weight`` observations, so one that training never saw stays
    possible. Without any labelled secret the random strings are uniform.
    """
    counts = {(r.random, r.a, r.b): r.n for r in transitions(labelled(docs, least_docs)).collect()}
    side = SIZE + 1
    logs = {}
    for kind in (True, False):
        n = [[counts.get((kind, a, b), 0) for b in range(side)] for a in range(side)]
        total = sum(map(sum, n))
        each = [(sum(row[b] for row in n) + 0.5) / (total + 0.5 * SIZE) for b in range(side)]
        logs[kind] = [
            math.log((n[a][b] + weight * each[b]) / (sum(n[a]) + weight)) if b else 0.0 for a in range(side) for b in range(side)
        ]
    return [p - q for p, q in zip(logs[True], logs[False])]


def ratio(token: Column, table: Column) -> Column:
    """Mean log-likelihood ratio of a token per character, random against ordinary."""
    codes = _codes(token)
    summed = F.aggregate(
        codes, F.struct(F.lit(0).alias("a"), F.lit(0.0).alias("s")),
        lambda acc, b: F.struct(b.alias("a"), (acc["s"] + F.element_at(table, acc["a"] * (SIZE + 1) + b + 1)).alias("s")),
    )["s"]
    return summed / F.char_length(token)


def scan(docs: DataFrame, threshold: float = 0.5, least_docs: int = 20_000) -> DataFrame:
    """(doc_id, text) → doc_id, spans: base spans and those of the models, ordered by start and kind.

    A span is (start, end, kind, value), code points, end exclusive; kinds are
    ``assign``, ``access``, ``hex`` and ``random``. A token of 20 characters or
    more becomes ``random`` if its mean log-likelihood ratio per character
    reaches ``threshold``, it has a digit, and no base span overlaps it. Null
    and empty texts have no span; one row comes back for each row.
    """
    docs = docs.select("doc_id", "text")
    table = F.array(*[F.lit(round(x, 6)) for x in train(docs, least_docs)])
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", base_spans(text).alias("base"), _spans(
        text, "random", TOKEN, lambda v: v.rlike("[0-9]")
    ).alias("tokens"))
    random = F.filter(_free(F.col("tokens"), F.col("base")), lambda t: ratio(t["value"], table) >= threshold)
    return found.select("doc_id", F.when(F.size("tokens") == 0, F.col("base")).otherwise(in_order(F.concat("base", random))).alias("spans"))
