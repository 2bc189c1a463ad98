"""URL filters: policy rules, then a list of canonical URLs behind a blocked Bloom filter.

Listed URLs set bits in a blocked filter (one block of 512 bits a URL, as eight longs).  A page's canonical URL is
probed against its block; only URLs that pass go to the exact hash join, which removes the false positives.
The list is written once, and its size decides how the two are joined, not whether: the filter and the list are broadcast if
they are under ``broadcast_bytes``; larger ones are joined by block and by URL, where rows of a hot block or URL are dealt out.

Null urls and those without :// have an empty host and path, fit no rule, and are never listed.  Repeated rows are
judged alike.  Null or repeated list entries do no harm; an empty list lists nothing; an empty table gives an empty result.  Very long urls
are judged whole.  Columns of pages other than id and url, and of the list other than its URL, are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.scratch import Scratch
from glyphmill.operators.skew import spread_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Fixed: the rules of the query, verdict and host/path.
RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("block", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]

WORDS_A_BLOCK, PROBES, BITS_A_URL = 8, 8, 16


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def canonical(host: Column, path: Column) -> Column:
    """Host and path without trailing slashes, scheme, query and fragment; null without a host."""
    return F.when(host != "", F.concat(host, F.regexp_replace(path, "/+$", "")))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls.  Rules are parameters of the plan, so few."""
    rule = verdict = None
    for what, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        h, p = text[: text.index("/")], text[text.index("/") :]
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def _bits(key: Column, blocks: int) -> tuple[Column, list[tuple[Column, Column]]]:
    """The block of a key, and for each of its longs the bits the key sets there."""
    h, g = F.xxhash64(key), F.xxhash64(key, F.lit(7))
    block = F.pmod(h, F.lit(blocks)).cast("int")
    masks = []
    for j in range(PROBES):  # one bit in each long: six fresh bits of g
        bit = F.shiftrightunsigned(g, 6 * j).bitwiseAND(F.lit(63).cast("long")).cast("int")
        masks.append(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return block, masks


def bloom(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """block, w0..w7: the blocked filter, built by bitwise or (partial sums before the shuffle)."""
    block, masks = _bits(F.col(key), blocks)
    rows = listed.where(F.col(key).isNotNull()).select(block.alias("_block"), *[m.alias(f"_w{j}") for j, m in enumerate(masks)])
    return rows.groupBy("_block").agg(*[F.bit_or(f"_w{j}").alias(f"_w{j}") for j in range(PROBES)])


def url_filter(
    pages: DataFrame,
    listed: DataFrame,
    rules: list[tuple[str, str]] | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    listed_col: str = "canonical_url",
    broadcast_bytes: int = 64 << 20,
) -> DataFrame:
    """id, host, path, rule, verdict, listed: the rule's verdict, else block if the canonical URL is listed."""
    rules = RULES if rules is None else rules
    scratch = Scratch(pages.sparkSession, "urls")
    keys = scratch.keep("listed", listed.select(F.col(listed_col).alias("_listed")).where(F.col("_listed").isNotNull()).distinct())
    n, chars = keys.agg(F.count("*"), F.coalesce(F.sum(F.length("_listed")), F.lit(0))).first()
    blocks = max(1, -(-n * BITS_A_URL // (64 * WORDS_A_BLOCK)))
    host, path = host_path(F.col("_url"))
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    rows = rows.select("_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("_key", canonical(F.col("host"), F.col("path")))
    rows = rows.withColumn("_block", _bits(F.col("_key"), blocks)[0])
    bits = bloom(keys, "_listed", blocks)
    rows = rows.join(F.broadcast(bits), "_block", "left") if blocks * 160 <= broadcast_bytes else spread_join(rows, ["_block"], "_id", bits, "left")
    passes = reduce(lambda a, b: a & b, [F.col(f"_w{j}").bitwiseAND(m) != 0 for j, m in enumerate(_bits(F.col("_key"), blocks)[1])])
    rows = rows.select("_id", "host", "path", F.when(passes, F.col("_key")).alias("_key"))
    exact = keys.select(F.col("_listed").alias("_key"), F.lit(True).alias("_hit"))
    rows = rows.join(F.broadcast(exact), "_key", "left") if n * 64 + 2 * chars <= broadcast_bytes else spread_join(rows, ["_key"], "_id", exact, "left")
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    hit = F.col("_hit").isNotNull()
    return rows.select(
        F.col("_id").alias(id_col), "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(hit, "block").otherwise("allow")).alias("verdict"), hit.alias("listed"),
    )
