"""URL filters: host and path rules first, then a list of canonical URLs behind a blocked Bloom filter; DataFrame functions only.

A rule (host, path) fits the URLs of its host and of all its subdomains whose path starts with the rule's path; of those that
fit, the longest (host and path together) decides, then the one with the longer host, then the one named first. A URL that no
rule fits is blocked if its canonical form is listed and allowed otherwise.

The list's canonical URLs are cut into blocks by one hash, and a second hash sets eight bits of the block's 256, two in each of
four words. The filter is a table of at most ``MAX_BLOCKS`` blocks, so it may be broadcast whatever the length of the list; a
list that overfills it only lets more URLs through. What passes may be listed and goes through an exact hash join with the list,
which removes the false positives; what does not pass is certainly not listed and is never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import free_name, quoted

#: Listed URLs that a block is made for, and blocks of the largest filter (40 bytes each).
PER_BLOCK, MAX_BLOCKS = 16, 1 << 19
_WORDS = 4
#: Fixed seed that makes the bits independent of the block.
_SEED = 0xB10C
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that do not tell one page from another.
TRACKING = "^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)"

Rule = tuple[str, str, str]


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def _host(rest: Column) -> Column:
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)


def _path(rest: Column) -> Column:
    return F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def listed_host(url: Column) -> Column:
    """Whether the host holds one of the words that put a page of the query's table on its list."""
    return _host(_after_scheme(url)).rlike(LISTED_WORDS)


def canonical_url(url: Column) -> Column:
    """Host and path with what does not tell pages apart removed: scheme, user, default port, last dot and leading ``www.`` of the
    host, fragment, tracking parameters and the order of the others. An empty path is ``/``. Null without a host."""
    rest = _after_scheme(url)
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(_host(rest), "^.*@", ""), "[.]?(:80|:443|:)?$", ""), "^www[.]", "")
    path = F.when(_path(rest) == "", F.lit("/")).otherwise(_path(rest))
    parts = F.split(F.regexp_extract(rest, "^[^?#]*[?]([^#]*)", 1), "&", -1)
    kept = F.array_join(F.array_sort(F.filter(parts, lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.when(host != "", F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit(""))))


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the rule that decides, null if none fits. ``rules`` is a list written by hand: it becomes one expression."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0])))
    for rule_host, rule_path, rule_verdict in reversed(ordered):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        text, verdict = F.when(fits, F.lit(rule_host + rule_path)).otherwise(text), F.when(fits, F.lit(rule_verdict)).otherwise(verdict)
    return text, verdict


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks)).cast("int")


def _masks(url: Column) -> list[Column]:
    bits = F.xxhash64(F.lit(_SEED), url)

    def bit(k: int) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(bits, 6 * k).bitwiseAND(F.lit(63)).cast("int"))

    return [bit(2 * k).bitwiseOR(bit(2 * k + 1)) for k in range(_WORDS)]


def bloom_filter(listed: DataFrame, column: str, blocks: int) -> DataFrame:
    """``block, w0 .. w3``: the blocks that hold a URL of ``listed``, partial ORs before the shuffle."""
    url = F.col(quoted(column))
    masks = listed.where(url.isNotNull()).select(_block(url, blocks).alias("block"), *(m.alias(f"w{k}") for k, m in enumerate(_masks(url))))
    return masks.groupBy("block").agg(*(F.bit_or(f"w{k}").alias(f"w{k}") for k in range(_WORDS)))


def blocks_for(n: int, most: int = MAX_BLOCKS) -> int:
    """A power of two, so that there is a block per ``PER_BLOCK`` listed URLs, ``most`` at most."""
    return min(most, 1 << max(0, (n - 1) // PER_BLOCK).bit_length())


def possible(urls: DataFrame, column: str, filter_table: DataFrame, blocks: int, listed: bool) -> DataFrame:
    """The rows of ``urls`` that the filter lets through, or those that it does not. ``filter_table`` has ``blocks`` rows at most
    and ``blocks`` is at most ``MAX_BLOCKS``, which bounds what is broadcast."""
    assert blocks <= MAX_BLOCKS
    url = F.col(quoted(column))
    taken = urls.columns
    names = {c: free_name(taken, f"filter_{c}") for c in filter_table.columns}
    side = filter_table.select(*(F.col(c).alias(n) for c, n in names.items()))
    hit = _block(url, blocks) == F.col(names["block"])
    for k, mask in enumerate(_masks(url)):
        hit = hit & (F.col(names[f"w{k}"]).bitwiseAND(mask) == mask)
    return urls.join(F.broadcast(side), hit & url.isNotNull(), "left_semi" if listed else "left_anti")


def judge(
    pages: DataFrame, listed: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", listed_col: str = "url", most: int = MAX_BLOCKS
) -> DataFrame:
    """``page_id, host, path, rule, verdict, canonical, is_listed`` per row of ``pages``; ``rule`` is null where none fits.

    ``listed`` has blocked URLs in any form; they are compared by canonical form and repeats count once. A null or empty URL, or
    one without ``://``, has an empty host and path, fits no rule that names a host, has no canonical form and is allowed; rows
    that repeat a page give a row each; an empty list blocks nothing, an empty table gives an empty result. Only the two columns
    named are read, so other columns may have any name. A URL that a third of all rows hold is looked up by many tasks: the list
    has it once and Spark splits the other side.
    """
    entries = materialise(listed.select(canonical_url(F.col(quoted(listed_col))).alias("entry")).where("entry IS NOT NULL").distinct())
    blocks = blocks_for(entries.count(), most)
    table = bloom_filter(entries, "entry", blocks)
    rest = _after_scheme(F.col(quoted(url_col)))
    urls = pages.select(F.col(quoted(id_col)).alias("page_id"), _host(rest).alias("host"), _path(rest).alias("path"), canonical_url(F.col(quoted(url_col))).alias("canonical"))
    passed = possible(urls, "canonical", table, blocks, True)
    exact = entries.withColumn("is_listed", F.lit(True)).hint("shuffle_hash")
    looked_up = passed.join(exact, F.col("canonical") == F.col("entry"), "left").drop("entry").withColumn("is_listed", F.coalesce("is_listed", F.lit(False)))
    clear = possible(urls, "canonical", table, blocks, False).withColumn("is_listed", F.lit(False))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("is_listed"), "block").otherwise("allow")
    return looked_up.unionByName(clear).select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "canonical", "is_listed")


#: The rules that the contract fixes.
RULES: list[Rule] = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: Words in a host that put a page's URL on the list of the query.
LISTED_WORDS = "spam|pills|adult|bets|casino|warez"

#: The query in DuckDB's SQL.
ORACLE = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1) AS query
  FROM cut
), named AS (
  SELECT page_id, host, path,
    regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), '[.]?(:80|:443|:)?$', ''), '^www[.]', '') AS site,
    array_to_string(list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '{TRACKING}'))), '&') AS kept
  FROM parts
), canon AS (
  SELECT page_id, host, path, CASE WHEN site <> '' THEN site || CASE WHEN path = '' THEN '/' ELSE path END
    || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END END AS canonical
  FROM named
), listed AS (SELECT DISTINCT canonical FROM canon WHERE regexp_matches(host, '{LISTED_WORDS}') AND canonical IS NOT NULL),
rules(host, path, says) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
fits AS (
  SELECT c.page_id, c.host, c.path, r.host || r.path AS rule, r.says,
    row_number() OVER (PARTITION BY c.page_id ORDER BY length(r.host || r.path) DESC) AS nth
  FROM canon c JOIN rules r ON (c.host = r.host OR ends_with(c.host, '.' || r.host)) AND starts_with(c.path, r.path)
)
SELECT c.page_id, c.host, c.path, f.rule, coalesce(f.says, CASE WHEN l.canonical IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
  c.canonical, l.canonical IS NOT NULL AS is_listed
FROM canon c LEFT JOIN (SELECT * FROM fits WHERE nth = 1) f USING (page_id) LEFT JOIN listed l ON c.canonical = l.canonical
"""
