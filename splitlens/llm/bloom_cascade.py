"""URL filters: a Bloom filter cascade for exact membership without joins.

Level 0 encodes the listed keys; level 1 encodes those keys of the corpus that are not listed but pass
level 0; level 2 the listed keys that pass level 1; and so on until a level lets nothing wrong pass. For
every key of the universe that the cascade was built over (all keys of the corpus and all listed keys)
the parity of the first level that it fails is its membership, exactly. A corpus row needs its own key
and the filters' words only, no join.

Everything is DataFrame functions: bit positions are ``xxhash64`` under different seeds, a filter is
built by ``bit_or`` of 64-bit words after a map-side combine, and it is read as an array by an
uncorrelated scalar subquery. The words of all levels of one shard take at most ``shard_bytes``. Shards, by a hash of the
key, are as many as the counts of listed and of all keys ask for; should a shard come out larger all the same, the
cascade is built anew over twice as many. Each shard has a cascade of its own that only its keys read, and
``filter_urls`` reads them one after the other, a pass over the addresses for each, so that one shard is in memory at a time.

Defined results: a null key is treated as the empty string; repeated keys and rows are judged alike; an
empty list lists nothing; listed keys that no row has change nothing; an empty table gives no rows; other columns pass
through, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitlens.llm.common import flat, place, saved

BITS_PER_KEY = (8, 2)  # of level 0, whose keys meet the whole universe, and of the others
HASHES = (4, 1)
SHARD_BYTES = 8 << 20
_WORD = "__word"


@dataclass
class Level:
    """Words of one filter: a one-row table, read as a scalar."""

    words: DataFrame
    bits: int
    hashes: int
    seed: int

    def passes(self, key: Column) -> Column:
        words = self.words.scalar()
        at = [position(key, self.seed, i, self.bits) for i in range(self.hashes)]
        # a word is looked up by its place: the array has them all, zero or not
        return reduce(Column.__and__, [F.bit_get(F.get(words, F.shiftright(p, 6).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1 for p in at])


def position(key: Column, seed: int, i: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed * 16 + i), key), F.lit(bits).cast("long"))


def build_level(keys: DataFrame, n: int, number: int, seed: int) -> Level:
    """A filter over the column ``key`` of ``keys``, of which there are ``n``."""
    per_key, hashes = BITS_PER_KEY[min(number, 1)], HASHES[min(number, 1)]
    bits = max(64, -(-n * per_key // 64) * 64)
    spark = keys.sparkSession
    at = keys.select(F.explode(F.array(*[position(F.col("key"), seed, i, bits) for i in range(hashes)])).alias("p"))
    # expr: the DataFrame function shiftleft takes a literal number of places only
    set_words = at.groupBy(F.shiftright("p", 6).alias(_WORD)).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(p, 64L) as int)))").alias("w"))
    every = spark.range(bits // 64).withColumnRenamed("id", _WORD).select(_WORD, F.lit(0).cast("long").alias("w"))
    whole = set_words.unionByName(every).groupBy(_WORD).agg(F.bit_or("w").alias("w"))
    words = saved(whole.agg(F.transform(F.array_sort(F.collect_list(F.struct(_WORD, "w"))), lambda x: x["w"]).alias("words")), "bloom-level")
    return Level(words, bits, hashes, seed)


@dataclass
class Cascade:
    """``shards[s]`` are the levels of shard ``s``."""

    shards: list[list[Level]]

    def contains(self, key: Column) -> Column:
        key = F.coalesce(key, F.lit(""))
        out = reduce(lambda rest, s: F.when(shard(key, len(self.shards)) == s, member(self.shards[s], key)).otherwise(rest), range(len(self.shards)), F.lit(False))
        return out


def shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(shards))


def member(levels: list[Level], key: Column) -> Column:
    """A key that fails level i first is listed if i is odd; one that passes all, if their number is odd."""
    out = F.lit(len(levels) % 2 == 1)
    for i in range(len(levels) - 1, -1, -1):
        out = F.when(levels[i].passes(key), out).otherwise(F.lit(i % 2 == 1))
    return out


def expected_bits(listed: int, every: int) -> int:
    """Bits of all levels of a cascade. A share of the keys that aren't listed passes level 0, and each level after it."""
    passes = [(1 - math.exp(-h / b)) ** h for h, b in zip(HASHES, BITS_PER_KEY, strict=True)]
    rest = BITS_PER_KEY[1] / (1 - passes[1] ** 2)
    return math.ceil(listed * (BITS_PER_KEY[0] + rest * passes[1]) + every * passes[0] * rest * (1 + passes[1]))


def build(universe: DataFrame, listed: DataFrame, *, shard_bytes: int = SHARD_BYTES) -> Cascade:
    """``universe``: a column ``key`` with every key that will be asked for; ``listed``: the same with the
    listed keys. Keys are aggregated before they are shuffled; a key on many rows is one row per task."""
    both = universe.select(F.coalesce("key", F.lit("")).alias("key"), F.lit(False).alias("listed")).unionByName(listed.select(F.coalesce("key", F.lit("")).alias("key"), F.lit(True).alias("listed")))
    keys = saved(both.groupBy("key").agg(F.max("listed").alias("listed")), "bloom-keys")
    every, n = keys.agg(F.count(F.lit(1)), F.count(F.when(F.col("listed"), 1))).first()
    shards = max(1, -(-expected_bits(n, every) // (8 * shard_bytes)))
    while (out := _shards(keys, n, shards, 8 * shard_bytes)) is None:
        shards *= 2
    return Cascade(out)


def _shards(keys: DataFrame, n: int, shards: int, most_bits: int) -> list[list[Level]] | None:
    """The levels of each shard; None if a shard takes more than ``most_bits`` and more than a word a level."""
    out = []
    for s in range(shards):
        own = keys.where(shard(F.col("key"), shards) == s)
        ahead, wrong = own.where("listed"), own.where(~F.col("listed"))
        left = n if shards == 1 else ahead.count()
        levels: list[Level] = []
        while left:
            levels.append(build_level(ahead, left, len(levels), 1 + s * 64 + len(levels)))
            if sum(x.bits for x in levels) > max(most_bits, 64 * len(levels)):
                return None
            ahead, wrong = saved(wrong.where(levels[-1].passes(F.col("key"))), "bloom-passed"), ahead
            left = ahead.count()
        out.append(levels)
    return out


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    at = F.locate("://", url)
    host = F.regexp_extract(F.substr(url, at + 3), r"(?s)^([^/?#]*)", 1)
    return F.when(url.isNull() | (at == 0), "").otherwise(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    at = F.locate("://", url)
    path = F.regexp_extract(F.substr(url, at + 3), r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(url.isNull() | (at == 0), "").otherwise(path)


@dataclass(frozen=True)
class Rule:
    """A decision for a host and all its subdomains where the path begins so."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | F.endswith(host, F.lit("." + self.host))) & F.startswith(path, F.lit(self.path))


def filter_urls(pages: DataFrame, rules: list[Rule], listed: DataFrame, *, url_col: str = "url", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``pages`` and: ``host``, ``path``, ``rule`` (of the longest rule that fits, else null) and ``verdict``:
    the rule's; without a rule ``block`` if the host is one of ``listed`` (column ``key``), else ``allow``.
    Columns of ``pages`` with one of these names are replaced."""
    rows, url = flat(pages), F.col(place(pages, url_col))
    keep = [(f"c{i}", c) for i, c in enumerate(pages.columns) if c.lower() not in ("host", "path", "rule", "verdict")]
    cut = rows.select(*[c for c, _ in keep], url_host(url).alias("host"), url_path(url).alias("path"))
    cascade = build(rows.select(url_host(url).alias("key")), listed, shard_bytes=shard_bytes)
    longest = sorted(rules, key=lambda r: (len(r.name), r.name), reverse=True)
    host, path = F.col("host"), F.col("path")
    rule = reduce(lambda rest, r: F.when(r.fits(host, path), r.name).otherwise(rest), longest[::-1], F.lit(None).cast("string"))
    by_rule = reduce(lambda rest, r: F.when(F.col("rule") == r.name, r.verdict).otherwise(rest), longest[::-1], F.lit(None).cast("string"))
    judged = lambda part, levels: part.withColumn("rule", rule).withColumn("verdict", F.coalesce(by_rule, F.when(member(levels, host), "block").otherwise("allow")))
    n = len(cascade.shards)
    if n == 1:
        out = judged(cut, cascade.shards[0])
    else:
        parts = [saved(judged(cut.where(shard(host, n) == s), levels), "judged") for s, levels in enumerate(cascade.shards)]
        out = reduce(DataFrame.unionByName, parts)
    return out.toDF(*[c for _, c in keep], "host", "path", "rule", "verdict")
