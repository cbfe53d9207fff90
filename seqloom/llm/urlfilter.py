"""URL rules by Bloom filter cascades.

A cascade answers membership exactly over a known key universe. Level 1 is a Bloom filter
of the listed keys; level 2 of the unlisted corpus keys that level 1 lets through; level 3
of the listed keys that level 2 lets through; and so on until a level lets nothing wrong
through. A key's answer is the parity of the first level that rejects it. Looking keys up
therefore needs no join: the filters, whose size is checked, go to every task.

Building: one pass over the corpus's keys keeps only those that pass level 1 (a map-side
test), and only these few are made distinct and compared with the list.

Defined cases: a null url, or one without `://`, has empty host and path and no rule;
rules are distinct (a key listed as both is blocked); repeated pages give repeated rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, release

#: Filters larger than this (all levels, in bits) are not broadcast; rules are then joined.
MAX_FILTER_BITS = 1 << 29
#: Positions are (a * multiplier + b) modulo this prime, then modulo the filter's bits; a and b are
#: two of a key's three hashes, another two for each level, so that keys which a level can
#: never tell apart are told apart by the next.
PRIME = (1 << 31) - 1
HASHES = ["a", "b", "c"]


def key_hashes(key: Column) -> list[Column]:
    """Three hashes of a key below the prime, so that a * multiplier + b stays in 63 bits."""
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(PRIME)).alias(HASHES[i]) for i in range(3)]


def _two(hashes: list, level: int) -> tuple:
    return hashes[level % 3], hashes[(level + 1) % 3]


def _salt(level: int, probe: int) -> int:
    """The multiplier of a probe; one of its own for each, so that no two keys keep colliding."""
    return (0x9E3779B97F4A7C15 * (64 * level + probe + 1) >> 20) % (PRIME - 1) + 1


@dataclass
class Level:
    number: int
    bits: int
    probes: int
    words: np.ndarray

    def has(self, hashes: list[np.ndarray]) -> np.ndarray:
        a, b = _two(hashes, self.number)
        ok = np.ones(len(a), dtype=bool)
        for j in range(self.probes):
            pos = (a * _salt(self.number, j) + b) % PRIME % self.bits
            ok &= (self.words[pos >> 6] >> (pos & 63).astype(np.uint64)) & np.uint64(1) == 1
        return ok


@dataclass
class Cascade:
    levels: list[Level] = field(default_factory=list)

    @property
    def bits(self) -> int:
        return sum(x.bits for x in self.levels)

    def member(self, hashes: list[np.ndarray]) -> np.ndarray:
        """Exact for every key of the universe that the cascade was built over."""
        n = len(hashes[0])
        if not self.levels:
            return np.zeros(n, dtype=bool)
        out = np.full(n, len(self.levels) % 2 == 1)
        alive = np.ones(n, dtype=bool)
        for i, level in enumerate(self.levels):
            hit = level.has(hashes)
            out[alive & ~hit] = i % 2 == 1
            alive &= hit
        return out


def _level(number: int, keys: DataFrame, n: int, bits_per_key: float) -> Level:
    """The bits are set by a grouped bit_or, so at most bits / 64 rows reach the driver."""
    bits = max(64, math.ceil(n * bits_per_key))
    probes = max(1, round(bits_per_key * math.log(2)))
    a, b = _two([F.col(c) for c in HASHES], number)
    pos = F.explode(F.array(*[(a * F.lit(_salt(number, j)) + b) % F.lit(PRIME) % F.lit(bits) for j in range(probes)])).alias("pos")
    rows = (
        keys.select(pos)
        .groupBy(F.shiftright("pos", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(pos & 63 as int))")).alias("set"))
        .collect()
    )
    words = np.zeros((bits + 63) // 64, dtype=np.uint64)
    for r in rows:
        words[r["word"]] = np.uint64(r["set"] & 0xFFFFFFFFFFFFFFFF)
    return Level(number, bits, probes, words)


def _passing(keys: DataFrame, level: Level) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(level)

    @F.pandas_udf("boolean")
    def has(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(shared.value.has([a.to_numpy(), b.to_numpy(), c.to_numpy()]))

    return keys.where(has(*HASHES))


def build_cascade(listed: DataFrame, universe: DataFrame, first_bits: float = 10.0, later_bits: float = 2.0, max_bits: int = MAX_FILTER_BITS) -> Cascade | None:
    """listed and universe have one column `key`. None if the filters would exceed max_bits."""
    hashed = lambda df: df.where(F.col("key").isNotNull()).select("key", *key_hashes(F.col("key")))
    listed = materialize(hashed(listed.distinct()), "listed")
    n = listed.count()
    if n == 0:
        return Cascade()
    if n * (first_bits + 4 * later_bits) > max_bits:
        return None
    cascade = Cascade([_level(0, listed, n, first_bits)])
    other = materialize(_passing(hashed(universe), cascade.levels[0]).distinct().join(listed.select("key"), "key", "left_anti"), "passed")
    inside = listed
    while (n := other.count()) > 0:
        if len(cascade.levels) > 60:
            raise ValueError("two keys share all their hashes")
        level = _level(len(cascade.levels), other, n, later_bits)
        cascade.levels.append(level)
        inside, other = other, materialize(_passing(inside, level), "passed")
    release(listed, inside, other)
    return cascade


def split_url(url: Column) -> tuple[Column, Column]:
    """Host after the first `://`, A-Z lower-cased, and path up to `?`, `#` or the end."""
    part = lambda i: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return ascii_lower(part(1)), part(2)


def candidate_keys(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """Host suffixes at label borders, each with the path prefixes of the lengths that rules
    have; the longest key first."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(
        F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in path_lengths]),
        lambda p: p.isNotNull(),
    )
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    ranked = F.sort_array(F.transform(keys, lambda k: F.struct(F.length(k).alias("n"), k.alias("key"))), asc=False)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(ranked, lambda r: r["key"]))


def apply_rules(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", max_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """Add host, path, rule and verdict to every page; pages may have any other columns.

    rules(rule STRING, verdict STRING): `host/path-prefix`; a rule fits its host and all
    subdomains where the path starts with the rule's. The longest fitting rule decides, and
    where none fits, the url's keys are on no list and the verdict is `default`."""
    host, path = split_url(F.col(url))
    clean = {c: f"__{c}" for c in ("host", "path", "rule", "verdict") if c in pages.columns}
    pages = pages.withColumnsRenamed(clean) if clean else pages
    rules = rules.where(F.col("rule").isNotNull()).select("rule", F.col("verdict") == "block").toDF("key", "block")
    rules = rules.groupBy("key").agg(F.max("block").alias("block"))
    # a few distinct path lengths, whatever the number of rules: bounded by the longest rule
    lengths = [r[0] for r in rules.select(F.length(F.regexp_extract("key", r"(?s)^[^/]*(.*)$", 1))).distinct().collect()] or [0]
    pages = pages.withColumns({"host": host, "path": path})
    pages = pages.withColumn("__keys", candidate_keys(F.col("host"), F.col("path"), sorted(lengths)))
    universe = pages.select(F.explode("__keys").alias("key"))
    cascades = [build_cascade(rules.where(F.col("block") == b).select("key"), universe, max_bits=max_bits) for b in (True, False)]
    if None in cascades:
        return _join_rules(pages, rules, default)
    return _look_up(pages, cascades, default)


def _look_up(pages: DataFrame, cascades: list[Cascade], default: str) -> DataFrame:
    shared = pages.sparkSession.sparkContext.broadcast(cascades)

    @F.pandas_udf("array<int>")
    def found(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        sizes = [0 if x is None else len(x) for x in a]
        join = lambda s: np.concatenate([np.zeros(0, np.int64), *[x for x in s if x is not None]]).astype(np.int64)
        hashes = [join(x) for x in (a, b, c)]
        block, allow = (cascade.member(hashes) for cascade in shared.value)
        code = np.where(block, 1, np.where(allow, 2, 0)).astype(np.int32)
        return pd.Series(np.split(code, np.cumsum(sizes)[:-1]) if sizes else [], dtype=object)

    hashes = lambda i: F.transform("__keys", lambda k: key_hashes(k)[i])
    out = pages.withColumn("__code", found(*map(hashes, range(3))))
    hit = F.filter(F.arrays_zip("__keys", "__code"), lambda x: x["__code"] > 0)
    out = out.withColumn("__hit", F.get(hit, F.lit(0)))
    verdict = F.when(F.col("__hit.__code") == 1, "block").when(F.col("__hit.__code") == 2, "allow").otherwise(default)
    return out.withColumns({"rule": F.col("__hit.__keys"), "verdict": verdict}).drop("__keys", "__code", "__hit")


def _join_rules(pages: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The other way, for lists whose filters are too large to send to every task."""
    pages = pages.withColumn("__row", F.monotonically_increasing_id())
    hits = pages.select("__row", F.posexplode("__keys").alias("at", "key")).join(rules, "key")
    best = hits.groupBy("__row").agg(F.min_by(F.struct("key", "block"), "at").alias("__hit"))
    out = pages.join(best, "__row", "left")
    verdict = F.when(F.col("__hit.block"), "block").when(~F.col("__hit.block"), "allow").otherwise(default)
    return out.withColumns({"rule": F.col("__hit.key"), "verdict": verdict}).drop("__keys", "__row", "__hit")


#: The production rules.
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def rules_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "rule string, verdict string")
