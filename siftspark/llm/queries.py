"""The registered queries of the corpus operators: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.llm import langid, license_scan, merkle, mixing, packing, quality_qda, quality_rules, simhash, url_filter, warc
from siftspark.llm.common import crc_fold, fresh_path, table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.mix_decisions(table(spark, sf_dir, "documents"))
    each = taken.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies", "source", F.explode(F.array_repeat(F.lit(0), F.col("many").cast("int"))))
    return each.drop("col")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    manifest = warc.archive_pages(pages, fresh_path(spark, "warc"))
    kind = pages.schema["page_id"].dataType
    found = warc.read_archives(manifest, payloads=True)
    return found.select(F.col("record_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def op4_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licences(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_texts(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


#: The score from which a text counts as of quality 1.
QUALITY_FROM = 0.3


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(crc_fold(F.col("doc_id"), 5) == 0, F.lit(False))
    model = quality_qda.fit(docs.where(~held_out), table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out.alias("held_out"), quality_qda.scores(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= QUALITY_FROM).cast("int"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("row.doc_id", *(f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_lines")))


#: The rules as host, path and verdict, and listed sites for URLs that no rule fits.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
URL_BULK = 4096  # more sites of the list, by number
URL_LISTED = [("spam-farm.example.com", "", "block"), ("spam-farm.example.net", "", "block"), ("spam-farm.example.org", "", "block")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    bulk = spark.range(URL_BULK).select(F.concat(F.lit("bulk-"), "id", F.lit(".example.org")).alias("host"), F.lit("").alias("path"), F.lit("block").alias("verdict"))
    judged = url_filter.judge(pages, url_filter.rules_of(spark, URL_RULES), url_filter.rules_of(spark, URL_LISTED).union(bulk))
    return judged.select("row.page_id", "host", "path", "rule", "verdict")


def op9_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = merkle.compare_with_edit(table(spark, sf_dir, "documents"))
    own, other, after = (F.col(f"trees.{x}") for x in ("own", "other", "after"))
    return compared.select(F.col("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), own["root"].alias("fingerprint"), other["root"].alias("edited_fingerprint"), merkle.likeness(own, other).alias("near_edited"), merkle.likeness(own, after).alias("near_next"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(crc_fold(F.col("doc_id"), 3) == 1, F.lit(False))
    model = langid.fit(docs.where(~held_out))
    found = langid.identify(docs, model).withColumnRenamed("id", "doc_id").withColumnRenamed("lang", "lang_pred")
    return found.select("doc_id", F.coalesce(crc_fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES = {f.__name__: f for f in (op1_mixing, op2_simhash, op3_warc, op4_license, op5_packing, op6_quality, op7_quality_rules, op8_url_filter, op9_merkle, op10_langid)}

_WORD = r"[^\x20\x09-\x0D]+"
_LINE_FAILS = rf"""len(regexp_extract_all(x, '{_WORD}')) > 0 AND (
    len(regexp_extract_all(x, '[#*$%&|<>]|!!')) >= {quality_rules.PER_WORD} * len(regexp_extract_all(x, '{_WORD}'))
    OR (len(regexp_extract_all(x, '{_WORD}')) >= 3 AND len(regexp_extract_all(x, '\p{{Lu}}{{2,}}')) >= {quality_rules.CAPITALS} * len(regexp_extract_all(x, '{_WORD}')))
    OR (len(regexp_extract_all(x, '{_WORD}')) <= {quality_rules.BOILERPLATE_WORDS} AND regexp_matches(lower(x), '{"|".join(quality_rules.BOILERPLATE)}')))"""

_OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY sha1(h), octet_length(encode(h))) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(x, CAST(5 * (k // 4) + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d
"""

_OP7 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '{_WORD}') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM d),
u AS (SELECT rid, unnest(ws) AS wd, generate_subscripts(ws, 1) AS i FROM w),
win AS (SELECT rid, i, wd || ' ' || lead(wd) OVER p || ' ' || lead(wd, 2) OVER p AS s FROM u WINDOW p AS (PARTITION BY rid ORDER BY i)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM win WHERE s IS NOT NULL) WHERE c >= 2),
cov AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM dup) GROUP BY rid),
k AS (SELECT rid, doc_id, t, ws, ls, list_distinct(list_filter(ls, lambda x: NOT ({_LINE_FAILS}))) AS good FROM w),
f AS (SELECT k.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) - len(good) AS BIGINT) AS removed_lines,
  coalesce(list_sum(list_transform(ls, lambda x: length(x))), 0) AS chars, coalesce(list_sum(list_transform(good, lambda x: length(x))), 0) AS kept_chars
  FROM k LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CASE WHEN chars > 0 THEN 1 - CAST(kept_chars AS DOUBLE) / CAST(chars AS DOUBLE) ELSE 0 END AS lost FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost <= {quality_rules.MOST_LOST} AS kept, removed_lines FROM b
"""


def _values(entries: list[tuple[str, str, str]]) -> str:
    return ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in entries)


_OP8 = f"""
WITH r(rh, rp, rv) AS (VALUES {_values(URL_RULES)}), l(lh, lp, lv) AS (VALUES {_values(URL_LISTED)} UNION ALL SELECT 'bulk-' || i || '.example.org', '', 'block' FROM range({URL_BULK}) t(i)),
p AS (SELECT row_number() OVER () AS rid, page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, contains(coalesce(url, ''), '://') AS good FROM pages),
a AS (SELECT rid, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS rv FROM p JOIN r ON good AND (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY rid),
b AS (SELECT rid, arg_max(lv, length(lh || lp)) AS lv FROM p JOIN l ON good AND (host = lh OR ends_with(host, '.' || lh)) AND starts_with(path, lp) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(rv, lv, 'allow') AS verdict FROM p LEFT JOIN a USING (rid) LEFT JOIN b USING (rid)
"""

_OP9 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
o AS (SELECT doc_id, t, row_number() OVER (ORDER BY doc_id DESC NULLS LAST, md5(t)) AS r FROM d),
n AS (SELECT doc_id, r, t, coalesce(lead(t) OVER (ORDER BY r), first_value(t) OVER (ORDER BY r)) AS nx, length(t) AS c FROM o),
e AS (SELECT doc_id, r, t, nx, c, substring(t, 1, c - c // 3) || substring(nx, 1, c // 3) AS ed FROM n),
x AS (SELECT r, 0 AS k, t AS s FROM e UNION ALL SELECT r, 1, ed FROM e UNION ALL SELECT r, 2, nx FROM e),
v AS (SELECT r, k, list_transform(string_split(s, chr(10)), lambda p: list_transform(regexp_extract_all(p, '{merkle.LEAF}'), lambda z: substring(md5(z), 1, 16) || ':' || length(z))) AS lv FROM x),
h AS (SELECT r, k, lv, list_transform(lv, lambda q: md5(coalesce(array_to_string(q, ','), ''))) AS ph FROM v),
s AS (SELECT r, k, list_distinct(flatten(lv)) AS lf, md5(array_to_string(list_transform(range(0, CAST(ceil(len(ph) / {merkle.SECTION}.0) AS BIGINT)), lambda g: md5(array_to_string(ph[g * {merkle.SECTION} + 1 : g * {merkle.SECTION} + {merkle.SECTION}], ','))), ',')) AS root FROM h),
m AS (SELECT a.r, a.root AS fingerprint, b.root AS edited_fingerprint, c.root AS next_root, a.lf AS al, b.lf AS bl, c.lf AS cl FROM s a JOIN s b ON a.r = b.r AND a.k = 0 AND b.k = 1 JOIN s c ON a.r = c.r AND c.k = 2),
q AS (SELECT r, fingerprint, edited_fingerprint, next_root,
  [CAST(coalesce(list_sum(list_transform(y, lambda z: CAST(split_part(z, ':', 2) AS BIGINT))), 0) AS DOUBLE) FOR y IN [al, bl, cl, list_intersect(al, bl), list_intersect(al, cl)]] AS g FROM m)
SELECT e.doc_id, CAST(e.c AS BIGINT) AS n_chars, sha256(e.ed) AS edited_sha256, fingerprint, edited_fingerprint,
  CASE WHEN fingerprint = edited_fingerprint THEN CAST(1 AS DOUBLE) WHEN g[1] + g[2] > 0 THEN 2 * g[4] / (g[1] + g[2]) ELSE CAST(0 AS DOUBLE) END AS near_edited,
  CASE WHEN fingerprint = next_root THEN CAST(1 AS DOUBLE) WHEN g[1] + g[3] > 0 THEN 2 * g[5] / (g[1] + g[3]) ELSE CAST(0 AS DOUBLE) END AS near_next
FROM e JOIN q USING (r)
"""

ORACLE_SQL: dict[str, str] = {"op3_warc": _OP3, "op7_quality_rules": _OP7, "op8_url_filter": _OP8, "op9_merkle": _OP9}
