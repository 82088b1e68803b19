"""The queries opN_<name> over the test tables, and SQL where it can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha(column: str):
    return F.sha2(F.col(column).cast("binary"), 256)


@query("op1_substring_dedup", """
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w),
keys AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + 49], ' ')) AS k FROM starts),
hits AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM keys) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM hits, (SELECT unnest(range(50)) AS j)),
places AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM places ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spotflow.llm.substring_dedup import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", sha("kept_text").alias("kept_sha256")
    )


@query("op6_exact_dedup", """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d
""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spotflow.llm.exact_dedup import DigestIndex

    return DigestIndex(spark, f"digests_{uuid.uuid4().hex}").decide(table(spark, sf_dir, "documents"), "documents")


@query("op4_byte_bpe")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from spotflow.llm.byte_bpe import encode

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).select(
        "doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), sha("decoded").alias("decoded_sha256"),
    )


def _joined(spans):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


@query("op10_secrets")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spotflow.llm.secrets import KINDS, scan

    kinds = [k for k, *_ in KINDS]

    def of_kind(kind: str):
        return lambda x: x["kind"] == kind

    base = F.filter("spans", lambda x: x["kind"].isin(kinds))
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[F.size(F.filter("spans", of_kind(k))).cast("long").alias(f"n_{k}") for k in kinds],
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
    )


@query("op5_simhash")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spotflow.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query("op8_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from spotflow.llm.language_id import identify, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = train(docs.where(~held), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query("op7_main_text")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spotflow.llm.main_text import main_text, train

    pages = table(spark, sf_dir, "pages")
    return main_text(pages.select("page_id", "url", "html"), train(pages)).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars")
    )


@query("op9_decontaminate")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spotflow.llm.decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_line_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spotflow.llm.line_dedup import line_dedup

    return line_dedup(table(spark, sf_dir, "documents"), seams=True).select(
        "doc_id", "n_lines", "n_removed", sha("kept_text").alias("kept_sha256")
    )


@query("op3_context_tree")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spotflow.llm.context_tree import score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return score(docs, docs.where(~held)).select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"
    )


@query("op11_source_divergence", """
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
w AS (SELECT id, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 10),
sums AS (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n FROM kept GROUP BY lang),
groups AS (SELECT lang, source, coalesce(any_value(n), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN (SELECT lang, source, sum(c) AS n FROM sums GROUP BY ALL) USING (lang, source) GROUP BY ALL),
shares AS (SELECT g.lang, g.source, k.term, coalesce(s.c, 0) AS c,
    1 + (1000000000::HUGEINT * (coalesce(s.c, 0) + 2)) // (g.n + 2 * l.v) AS p,
    1 + (1000000000::HUGEINT * (k.total + 2)) // (l.n + 2 * l.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source AND s.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
all_pairs AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(p.value, 0) AS value FROM groups g
  JOIN groups h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN pairs p ON p.lang = g.lang AND p.source = g.source AND p.item = h.source),
own AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM shares WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r
  FROM (SELECT * FROM all_pairs UNION ALL SELECT * FROM own))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(r AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR r <= 10
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spotflow.llm.source_divergence import divergence

    return divergence(table(spark, sf_dir, "documents"))


@query("op12_filter_interaction", """
WITH d AS (SELECT coalesce(lang, '') AS part, doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT part, doc_id, t, list_filter(string_split_regex(t, '[ \\x09-\\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
f AS (SELECT part, doc_id, len(ws) < 100 AS a, 100 * len(list_distinct(ws)) < 80 * len(ws) AS b,
    100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 10 * length(t) AS c,
    regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > first, false) AS e FROM m),
flags AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
masks AS (SELECT part, [x for x in [if(a, 'A', ''), if(b, 'B', ''), if(c, 'C', ''), if(d, 'D', ''), if(e, 'E', '')] if x <> ''] AS fails,
    count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN flags USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (SELECT [a.l, b.l, c.l, d.l, e.l] AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
fate AS (SELECT masks.*, o, coalesce(list_min(list_transform(fails, lambda y: list_position(o, y))), 9) AS step FROM masks, orders),
steps AS (SELECT part, o, s.i AS step, o[s.i] AS letter, sum(n) FILTER (fate.step > s.i) AS kept, sum(n) FILTER (fate.step = s.i) AS removed,
    sum(n) FILTER (fate.step < s.i AND list_contains(fails, o[s.i])) AS redundant, sum(n) FILTER (fails = [o[s.i]]) AS unique_fails,
    sum(good) FILTER (fate.step = s.i) AS good_lost, sum(toxic) FILTER (fate.step = s.i) AS toxic_lost
  FROM fate, (SELECT unnest(range(1, 6)) AS i) s GROUP BY ALL)
SELECT part, array_to_string(o, '') AS filter_order, CAST(step AS INTEGER) AS step,
  CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM steps
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spotflow.llm.filter_interaction import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op13_embedding_near_dedup", """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
reach AS (SELECT r AS a, r AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a AS r, min(vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN least USING (r) LEFT JOIN (SELECT a AS r, count(*) AS n FROM links GROUP BY a) USING (r)
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spotflow.llm.pivot_index import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))
