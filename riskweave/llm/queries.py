"""The registered queries of the dealt operators: thin digests of what the
operators return, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontaminate, embedding, filters, language, mixing, quality, sharding, simhash, substring, suffix, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents").select("doc_id"))


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 4) == 2
    found = language.identify(docs.select("doc_id", "text"), language.fit(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "distance", "rejected")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.mark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 3) == 1
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = alignment.align(table(spark, sf_dir, "documents"))
    digest = F.when(F.col("n_a") == 0, F.lit("")).otherwise(F.sha2("groups", 256))
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 4) == 2
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return quality.score(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mixing, op2_sharding, op3_warc_revisits, op4_simhash, op5_suffix_array, op6_language,
                            op7_decontaminate, op8_substring, op9_toxicity, op10_embedding, op11_filter_audit, op12_alignment, op13_quality, pipeline)}

#: Slots are filled by a recursive query that holds the table as a list.
_OP2 = f"""
WITH RECURSIVE shards AS (
  SELECT i, ('0x' || substr(md5('shard-' || i || '-offset'), 1, 15))::BIGINT % {sharding.SLOTS} AS start,
         ('0x' || substr(md5('shard-' || i || '-skip'), 1, 15))::BIGINT % {sharding.SLOTS - 1} + 1 AS skip
  FROM range({sharding.SHARDS}) t(i)),
orders AS (
  SELECT i, list((start + p * skip) % {sharding.SLOTS} ORDER BY p) AS prefers FROM shards, range({sharding.SLOTS}) r(p) GROUP BY i),
turns AS (
  SELECT 0::BIGINT AS turn, []::BIGINT[] AS taken
  UNION ALL
  SELECT turn + 1, list_append(taken, list_filter(prefers, lambda s: NOT list_contains(taken, s))[1])
  FROM turns JOIN orders ON i = turn % {sharding.SHARDS} WHERE turn < {sharding.SLOTS}),
filled AS (SELECT taken FROM turns WHERE turn = {sharding.SLOTS}),
lookup AS (
  SELECT unnest(taken)::INTEGER AS slot, (unnest(range({sharding.SLOTS})) % {sharding.SHARDS})::INTEGER AS shard FROM filled)
SELECT doc_id, slot, shard
FROM (SELECT doc_id, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '\\N')), 1, 15))::BIGINT % {sharding.SLOTS})::INTEGER AS slot FROM documents)
JOIN lookup USING (slot)
"""

_B32 = " || ".join(
    f"substr('{warc.BASE32}', (((('0x' || substr(h, {5 * g + 1}, 5))::BIGINT >> {by}) & 31) + 1)::BIGINT, 1)" for g in range(8) for by in (15, 10, 5, 0))
_OP3 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha1(payload) AS h FROM p),
o AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS original FROM d)
SELECT page_id, payload_bytes, {_B32} AS payload_digest,
       CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = original THEN NULL ELSE original END AS refers_to
FROM o
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS7 = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP7 = f"""
WITH doc AS (SELECT doc_id, coalesce({_WORDS7.format(_LOWER.format('text'))}, []) AS w FROM documents),
item AS (SELECT item_id, coalesce({_WORDS7.format(_LOWER.format('text'))}, []) AS w FROM benchmark),
win AS (
  SELECT item_id, least(len(w), {decontaminate.WINDOW}) AS n,
         array_to_string(w[s:s + least(len(w), {decontaminate.WINDOW}) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {decontaminate.WINDOW - 1}, 1) + 1)) AS s FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
spot AS (
  SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS t
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM doc, sizes WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, s, n, item_id FROM spot JOIN win USING (n, t)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP8 = rf"""
WITH doc AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
spot AS (
  SELECT doc_id, s, md5(array_to_string(w[s:s + {substring.WINDOW - 1}], ' ')) AS t
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {substring.WINDOW} + 2)) AS s FROM doc WHERE len(w) >= {substring.WINDOW})),
repeat AS (SELECT doc_id, s FROM spot SEMI JOIN (SELECT t FROM spot GROUP BY t HAVING count(*) > 1) USING (t)),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + {substring.WINDOW})) AS p FROM repeat),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM doc),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (doc_id)
"""

#: Every step of every order against every document's failed filters.
_OP11 = rf"""
WITH doc AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
first AS (SELECT t, min(doc_id) AS original FROM doc GROUP BY t),
mark AS (
  SELECT doc_id, part, len(w) < {filters.MIN_WORDS} AS fa, 100 * len(list_distinct(w)) < {filters.DISTINCT_SHARE} * len(w) AS fb,
         100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > {filters.CAPITAL_SHARE} * length(t) AS fc,
         regexp_matches(t, '{filters.SYMBOLS}') AS fd, coalesce(doc_id > original, false) AS fe
  FROM doc JOIN first USING (t)),
label AS (SELECT doc_id, coalesce(max(quality = 1), false) AS good, coalesce(max(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
fails AS (
  SELECT part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda f, i: [fa, fb, fc, fd, fe][i]) AS f, count(*) AS n,
         count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM mark LEFT JOIN label USING (doc_id) GROUP BY 1, 2),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT o, s, o[s] AS own, o[1:s - 1] AS before FROM orders, range(1, 6) r(s)),
counted AS (
  SELECT part, array_to_string(o, '') AS filter_order, s::INTEGER AS step, own,
         sum(n) FILTER (WHERE NOT list_has_any(f, before) AND NOT list_contains(f, own)) AS kept,
         sum(n) FILTER (WHERE NOT list_has_any(f, before) AND list_contains(f, own)) AS removed,
         sum(n) FILTER (WHERE list_has_any(f, before) AND list_contains(f, own)) AS redundant,
         sum(n) FILTER (WHERE f = [own]) AS unique_fails,
         sum(good) FILTER (WHERE NOT list_has_any(f, before) AND list_contains(f, own)) AS good_lost,
         sum(toxic) FILTER (WHERE NOT list_has_any(f, before) AND list_contains(f, own)) AS toxic_lost
  FROM fails, steps GROUP BY part, o, s, own)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, own), 0)::BIGINT AS shapley
FROM counted
"""

#: Operators that no SQL text expresses (iterations, fitted models, tokenizers, XXH64) have none; tests hold them against brute force.
ORACLE: dict[str, str] = {"op2_sharding": _OP2, "op3_warc_revisits": _OP3, "op7_decontaminate": _OP7, "op8_substring": _OP8, "op11_filter_audit": _OP11}
