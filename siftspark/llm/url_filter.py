"""URL filters: a blocked Bloom filter before an exact join, in native expressions.

A listed entry is a canonical host with a path prefix; it fits that host and its
subdomains. A URL's candidate keys are its host suffixes with its path's prefixes at the
lengths that listed paths have. One block of the filter is one 64-bit word, found by one
part of a key's hash; a few of its bits, chosen by other parts, must all be set. Keys
that pass meet the list in an exact hash join, which removes false positives.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftspark.functions.tables import constant
from siftspark.llm.common import met

#: Bits a listed key sets in its block, and blocks a listed key.
BITS, BLOCKS_PER_KEY = 4, 0.5
#: Blocks (16 bytes each) up to which the filter, and rows (some 100 bytes each) up to which the list is sent to all executors.
BLOCKS_SENT, LIST_SENT = 500_000, 50_000
#: Distinct lengths of listed paths up to which only prefixes of these lengths are candidates; beyond, all are.
MOST_LENGTHS = 64


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or end, A-Z lower-cased; empty where there is none."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or end; empty where there is none."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _bits(key: Column) -> Column:
    """The word with a key's bits set."""
    h = F.xxhash64(key, F.lit(1))
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int"))
    return reduce(lambda a, b: a.bitwiseOR(b), (bit(k) for k in range(BITS)))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """The filter of a column key as (block, word); blocks without a key are left out."""
    return keys.groupBy(_block(F.col("key"), blocks).alias("block")).agg(F.bit_or(_bits(F.col("key"))).alias("word"))


def rules_of(spark, entries: list[tuple[str, str, str]]) -> DataFrame:
    """A list of (host, path, verdict) as a DataFrame."""
    return constant(spark, entries, "host string, path string, verdict string")


def _candidates(lengths: list[int] | None) -> Column:
    """A URL's keys: suffixes of host with prefixes of path, of the given lengths or of all."""
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    every = F.sequence(F.lit(0), F.length("path")) if lengths is None else F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("path"))
    return F.flatten(F.transform(suffixes, lambda x: F.transform(every, lambda n: F.concat(x, F.lit(" "), F.substring("path", F.lit(1), n)))))


def decide(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, rule, verdict) of the distinct urls of a column url that an entry of rules fits; the longest wins.

    rules has host, path ('' fits all paths) and verdict; longest is by characters of
    host and path together, ties go to the longer host, then to block over allow. The
    filter is tested where the URLs are read: only keys that pass it are shuffled, to the
    exact join. A filter of more than BLOCKS_SENT blocks is joined by block instead.
    """
    strict = F.struct((F.col("verdict") == "block").cast("int").alias("strict"), "verdict")
    listed = rules.groupBy("host", "path").agg(F.max(strict).alias("s")).select(F.concat("host", F.lit(" "), "path").alias("key"), F.concat("host", "path").alias("rule"), "s.strict", "s.verdict", F.length(F.concat("host", "path")).alias("long"), F.length("host").alias("host_long"), F.length("path").alias("n"))
    about = listed.agg(F.count(F.lit(1)).alias("size"), F.slice(F.sort_array(F.collect_set(F.least("n", F.lit(MOST_LENGTHS * 100)))), 1, MOST_LENGTHS + 1).alias("lengths")).first()
    size, blocks = about["size"], max(1, int(about["size"] * BLOCKS_PER_KEY) + 1)
    listed = listed.drop("n")
    # with very many lengths all prefixes of a path are its candidates: more keys to test, none lost
    few = about["lengths"] if len(about["lengths"]) <= MOST_LENGTHS and max(about["lengths"], default=0) < MOST_LENGTHS * 100 else None
    parts = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    keyed = parts.select("url", F.explode(_candidates(few)).alias("key")).withColumn("block", _block(F.col("key"), blocks))
    words = bloom(listed.select("key"), blocks)
    if blocks <= BLOCKS_SENT:
        tested = keyed.join(F.broadcast(words), "block")
    else:
        tested = met(keyed, words.join(keyed.groupBy("block").agg(F.count(F.lit(1)).alias("n")), "block"), "block")
    hits = tested.where(F.col("word").bitwiseAND(_bits(F.col("key"))) == _bits(F.col("key"))).select("url", "key")
    if size <= LIST_SENT:
        exact = hits.join(F.broadcast(listed), "key")
    else:
        exact = met(hits, listed.join(hits.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key"), "key")
    best = F.struct("long", "host_long", "strict", "rule", "verdict")
    return exact.groupBy("url").agg(F.max(best).alias("best")).select("url", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, url_col: str = "url") -> DataFrame:
    """(row, host, path, rule, verdict) of every row of pages: a rule's verdict where one fits, else the list's, else allow.

    rules and listed both have host, path and verdict; a listed entry decides only where
    no rule fits, and leaves rule null. A null URL or one without :// has empty host and
    path, which no entry fits. Repeated rows come back as often; an empty list fits nothing.
    """
    urls = pages.select(F.col(url_col).alias("url")).where(F.col("url").contains("://"))
    ruled = decide(urls, rules).select(F.col("url").alias("_u"), "rule", F.col("verdict").alias("_rv"))
    other = decide(urls, listed).select(F.col("url").alias("_w"), F.col("verdict").alias("_lv"))
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("row"), F.col(url_col).alias("_url"))
    found = rows.join(ruled, rows["_url"] == ruled["_u"], "left").join(other, rows["_url"] == other["_w"], "left")
    return found.select("row", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"), "rule", F.coalesce("_rv", "_lv", F.lit("allow")).alias("verdict"))
