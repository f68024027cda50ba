"""URL filters: host and path rules, and a list of URLs behind a blocked Bloom filter. DataFrame functions only.

Rules: a rule fits its host and all subdomains if the URL's path starts with the rule's path; the longest rule
that fits decides. Where none fits, a URL is blocked if its canonical form is listed.

The list's Bloom filter is a table of blocks of 64 bits. A URL's hash picks its block and, with a second hash,
four bits of it, so a probe reads one block: pages are joined to the blocks by number, which is a broadcast only as long as the
filter has at most bloom.BROADCAST_BLOCKS blocks (16 bytes each). Pages whose bits are all set go on to an exact join with the
list, which removes false positives; the others never enter a shuffle.

Canonical form: host in lower case without `www.` and default port, path without `/` at its end, query without
tracking parameters and sorted; scheme and fragment dropped. Null URLs and URLs without `://` have empty host and path,
fit no rule, are not listed and are allowed. Repeated pages are judged one by one. An empty list blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import table, without

Rule = tuple[str, str, str]
#: (verdict, host, path), fixed values of the query.
RULES: list[Rule] = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
MAX_RULES = 200
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
QUERY = r"(?s)^.*?://[^?#]*\?([^#]*)"
ADDED = ("host", "path", "rule", "canonical", "listed", "verdict")


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    return F.coalesce(_lower(F.regexp_extract(url, URL, 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def canonical(url: Column, host_: Column, path_: Column) -> Column:
    """Null where the URL has no host."""
    bare = F.regexp_replace(F.regexp_replace(host_, r"^www\.", ""), r":(80|443)$", "")
    params = F.array_sort(F.filter(F.split(F.regexp_extract(url, QUERY, 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    query = F.array_join(params, "&")
    return F.when(host_ != "", F.concat(bare, F.regexp_replace(path_, "/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def rule_that_fits(host_: Column, path_: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule as text, its verdict); both null where none fits. rules is a parameter of at most MAX_RULES entries."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    name = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def listed_keys(pages: DataFrame, listed: DataFrame, key: str = "canonical") -> DataFrame:
    """pages with a column listed: whether the key is in listed(url)."""
    k = F.col(key)
    probed = bloom.probe(pages, k, *bloom.build(listed, "url"))
    passed = probed.where("__possible").join(listed.select(F.col("url").alias("__url")), k == F.col("__url"), "left")
    passed = passed.withColumn("listed", F.col("__url").isNotNull()).drop("__url", "__possible")
    return passed.unionByName(probed.where("not __possible").withColumn("listed", F.lit(False)).drop("__possible"))


def judge(pages: DataFrame, listed: DataFrame, rules: list[Rule] = RULES, url_col: str = "url") -> DataFrame:
    """pages with host, path, rule, canonical, listed and verdict. listed(url): canonical URLs. Columns of these names are replaced."""
    url = F.col(f"`{url_col}`")
    if url_col in ADDED:
        raise ValueError(f"rename the column {url_col}")
    rows = without(pages, *ADDED).withColumn("host", host(url)).withColumn("path", path(url))
    name, verdict = rule_that_fits(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", name).withColumn("__verdict", verdict).withColumn("canonical", canonical(url, F.col("host"), F.col("path")))
    rows = listed_keys(rows, listed.select("url").where("url is not null").distinct())
    return rows.withColumn("verdict", F.coalesce("__verdict", F.when(F.col("listed"), F.lit("block")).otherwise("allow"))).drop("__verdict")


def repeated_urls(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Canonical URLs that more than one page has: the list that the query uses."""
    url = F.col(f"`{url_col}`")
    keys = pages.select(canonical(url, host(url), path(url)).alias("url")).where("url is not null")
    return keys.groupBy("url").count().where("count > 1").select("url")


def query(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, repeated_urls(pages)).select("page_id", "host", "path", "rule", "verdict", "listed")


SQL = r"""
with p as (
  select page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') path,
    list_sort(list_filter(string_split(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)'))) params
  from pages),
c as (
  select *, case when host <> '' then regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '') || case when len(params) > 0 then '?' || array_to_string(params, '&') else '' end end canon,
    case when (host = 'example.org' or suffix(host, '.example.org')) and prefix(path, '/en/1') then 'example.org/en/1'
      when (host = 'example.org' or suffix(host, '.example.org')) and prefix(path, '/es/') then 'example.org/es/'
      when (host = 'com' or suffix(host, '.com')) and prefix(path, '/fr/') then 'com/fr/'
      when (host = 'com' or suffix(host, '.com')) and prefix(path, '/de/') then 'com/de/'
      when (host = 'org' or suffix(host, '.org')) and prefix(path, '/') then 'org/' end rule
  from p),
l as (select *, canon is not null and count(*) over (partition by canon) > 1 listed from c)
select page_id, host, path, rule, case when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block' when listed then 'block' else 'allow' end verdict, listed from l
"""
