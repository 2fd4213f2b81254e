"""URL filter: path rules first, then a blocked Bloom filter in front of an exact join with the listed URLs."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import ascii_lower

LANES = 8  # words of 64 bits in a block, one bit of each for a key
URL = r"://([^/?#]*)([^?#]*)"


class Rule(NamedTuple):
    action: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column | str) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z in lower case."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")))


def path_of(url: Column | str) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """One spelling for the addresses of a page: no scheme, mirror prefix, query, anchor, suffix or last slash."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"(\.html|/)$", ""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and action of the longest rule that fits (of equally long ones: longer host, then block)."""
    ranked = sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.action != "block", r.text))
    fits = [((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path) for r in ranked]
    pick = lambda field: F.coalesce(
        *[F.when(fit, F.lit(getattr(r, field))) for fit, r in zip(fits, ranked)], F.lit(None).cast("string"))
    return pick("text"), pick("action")


def _block_and_bits(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    place, bits = F.xxhash64(key), F.xxhash64(key, F.lit("bits"))
    lanes = [F.call_function("shiftleft", F.lit(1).cast("long"),
                             F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
             for i in range(LANES)]
    return F.pmod(place, F.lit(blocks)).cast("int"), lanes


def bloom_blocks(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter as a table: a row for each block that has a key, with its eight words."""
    block, lanes = _block_and_bits(F.col(key), blocks)
    bits = keys.select(block.alias("_block"), *[lane.alias(f"_w{i}") for i, lane in enumerate(lanes)])
    return bits.groupBy("_block").agg(*[F.bit_or(f"_w{i}").alias(f"_w{i}") for i in range(LANES)])


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[Rule], url: str = "url",
                blocks: int = 1 << 15) -> DataFrame:
    """Adds host, path, rule and verdict to every row of ``pages``.

    ``listed`` has one column ``key`` of canonical URLs to block; NULLs and repeats in it do
    nothing. A page that a rule fits gets the rule's action. The others are blocked if their
    canonical URL is listed, else allowed. NULL, empty and other URLs without ``://`` have an
    empty host and path, fit no rule (a path rule needs its path) and are allowed unless the empty key
    is listed. Rows are never merged: repeated pages get a verdict each.
    Columns of ``pages`` named like an added one are replaced; all others stay, whatever their names. An empty table gives no rows.

    The filter has at most ``blocks`` rows of 72 bytes (2.4 MB as set), whatever the list's
    length, so it may be broadcast; a longer list only lets more rows pass to the exact
    join, where a hot URL meets one row of the list and skewed partitions can be split.
    """
    keys = listed.select(F.col("key").alias("_key")).where("_key IS NOT NULL").distinct()
    given = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    # The columns given travel in one, so that no name of theirs can clash with those made here.
    pages = pages.select(F.struct(*[F.col(f"`{c}`") for c in given]).alias("_given"), F.col(url).alias("_url"))
    host, path = host_of(F.col("_url")), path_of(F.col("_url"))
    base = pages
    parsed = base.withColumns({"host": host, "path": path})
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumns({"rule": rule, "_action": action, "_url_key": canonical(F.col("host"), F.col("path"))})
    block, lanes = _block_and_bits(F.col("_url_key"), blocks)
    probed = parsed.withColumn("_block", block).join(F.broadcast(bloom_blocks(keys, "_key", blocks)), "_block", "left")
    hit = F.lit(True)
    for i, lane in enumerate(lanes):
        hit &= F.col(f"_w{i}").bitwiseAND(lane) == lane
    probed = probed.withColumn("_maybe", F.col("_action").isNull() & F.coalesce(hit, F.lit(False)))
    passed = probed.where("_maybe").join(keys, F.col("_url_key") == F.col("_key"), "left")
    rest = probed.where("NOT _maybe").withColumn("_key", F.lit(None).cast("string"))
    verdict = F.coalesce("_action", F.when(F.col("_key").isNotNull(), "block").otherwise("allow"))
    columns = ["_given.*", "host", "path", "rule", verdict.alias("verdict")]
    return rest.select(*columns).unionAll(passed.select(*columns))
