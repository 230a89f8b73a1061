"""Operator 7: URL filtering by host and path rules, and by a list of canonical URLs.

A listed URL is looked up in two steps: a blocked Bloom filter passes the possible hits, and an exact hash join on the
canonical URL removes the false ones. The filter is a table of blocks (one 64-bit word each, in which a URL sets a few bits), built by a
partial aggregation. It is broadcast only while its blocks, fixed by the list's counted size, stay below a bound; a larger filter is joined by
block, so neither the list nor the filter has to fit anywhere as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import free_name

#: (verdict, host, path)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
BITS_PER_URL = 16
BITS_SET = 6
MOST_BROADCAST = 4_000_000  # blocks; 64 MB as rows of two longs


def url_host(url: Column) -> Column:
    """What stands between the first :// and the next / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column, url: Column) -> Column:
    """Host without www. or m. and port, path without trailing slashes, and the query without tracking parameters; null without a host."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(?:utm_[a-z]+|ref|fbclid|gclid)(?:=|$)")))
    bare = F.regexp_replace(F.regexp_replace(host, "^(?:www|m)[.]", ""), ":[0-9]*$", "")
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(host != "", F.concat(bare, F.regexp_replace(path, "/+$", ""), query))


def fitting_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """The longest rule (host and path together) that fits, as text, and its verdict; null where none does.

    `rules` is a parameter of the job, a few thousand at most. Of rules of equal length, the one with the longer host wins.
    """
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1:]))
    rule = verdict = F.lit(None).cast("string")
    for kind, h, p in reversed(ranked):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bits(key: Column) -> Column:
    """The word of a URL's bits within its block."""
    h = F.xxhash64(key, F.lit("bits"))
    word = F.lit(0).cast("long")
    for i in range(BITS_SET):
        word = word.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int")))
    return word


def bloom_blocks(listed: DataFrame, blocks: int, column: str = "canonical") -> DataFrame:
    """The filter's non-empty blocks: block and word."""
    return listed.groupBy(_block(F.col(column), blocks).alias("block")).agg(F.bit_or(_bits(F.col(column))).alias("word"))


def mark_listed(urls: DataFrame, listed: DataFrame, column: str = "canonical") -> DataFrame:
    """Adds `listed` to urls: whether the canonical URL is in the list. Only rows that the Bloom filter passes are shuffled.

    A null is never listed. Repeated list entries count once; repeated rows of `urls` are all returned. An empty list marks no row.
    """
    wanted = listed.where(F.col(column).isNotNull()).select(column).distinct()
    blocks = max(1, -(-wanted.count() * BITS_PER_URL // 64))
    words = bloom_blocks(wanted, blocks, column)
    words = F.broadcast(words) if blocks <= MOST_BROADCAST else words
    bits, block, word, possible = _bits(F.col(column)), *(free_name(urls, n) for n in ("block", "word", "possible"))
    marked = urls.withColumn(block, _block(F.coalesce(column, F.lit("")), blocks)).join(words.select(F.col("block").alias(block), F.col("word").alias(word)), block, "left")
    marked = marked.withColumn(possible, F.coalesce(F.col(word).bitwiseAND(bits) == bits, F.lit(False))).drop(block, word)
    sure = marked.where(F.col(possible)).join(wanted.withColumn("listed", F.lit(True)), column, "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    return marked.where(~F.col(possible)).withColumn("listed", F.lit(False)).unionByName(sure).drop(possible)


def judge(pages: DataFrame, listed: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """Returns page_id, host, path, rule and verdict of every page; `listed` has a column `canonical` of blocked URLs.

    A fitting rule decides; without one, a listed URL is blocked and any other allowed. Null URLs and URLs without :// have empty
    host and path, fit no rule and are allowed. Pages are counted one by one: repeated rows stay repeated. Other columns
    are ignored, so their names cannot clash.
    """
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url")).withColumn("host", url_host(F.col("url"))).withColumn("path", url_path(F.col("url")))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    wanted = F.when(rule.isNull(), canonical(F.col("host"), F.col("path"), F.col("url")))  # a rule's verdict needs no look at the list
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), wanted.alias("canonical"))
    judged = F.coalesce("ruled", F.when(F.col("listed"), "block").otherwise("allow"))
    return mark_listed(rows, listed).select("page_id", "host", "path", "rule", judged.alias("verdict"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages. No list comes with the tables, so the listed URLs are those of the pages whose page_id is divisible by 20."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    url = F.col("url")
    listed = pages.where("page_id % 20 = 0").select(canonical(url_host(url), url_path(url), url).alias("canonical"))
    return judge(pages, listed)


SQL = r"""
with p as (
  select page_id, url,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
q as (
  select *, list_sort(list_filter(string_split(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) as kept
  from p),
c as (
  select page_id, host, path, case when host <> '' then regexp_replace(regexp_replace(host, '^(www|m)[.]', ''), ':[0-9]*$', '') || regexp_replace(path, '/+$', '')
    || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end end as canonical
  from q),
rules(verdict, h, p) as (values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
fit as (
  select page_id, h || p as rule, verdict, row_number() over (partition by page_id order by length(h || p) desc, length(h) desc) as n
  from c join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
select page_id, host, path, rule, coalesce(verdict, case when canonical in (select canonical from c where page_id % 20 = 0 and canonical is not null) then 'block' else 'allow' end) as verdict
from c left join (select * from fit where n = 1) using (page_id)
"""
