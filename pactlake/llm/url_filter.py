"""Exact URL filtering with a Bloom filter cascade.

Listed keys are encoded by a first Bloom filter; the keys of the corpus that pass it without being listed by a second; the
listed ones that pass the second by a third; and so on, until a level passes nothing wrong. Over the corpus's complete
universe of keys the cascade then answers membership exactly, and each row is judged by bit tests alone, without a join.

The first level is sized so that its false positives are about as many as the listed keys, so all levels together follow
the listed keys that occur in the corpus and the logarithm of the universe. A level is held in slices, arrays of 64-bit words
that are made each by a task of its own and read as scalar subqueries. Its size is bounded and checked: a list that needs more than MAX_BITS
in a level (1 GB, which executors must hold; some 300 million keys that occur, or more) is joined with the keys instead, with the same
result.

Rules (host, path) are listed as host + path and fit a host, all its subdomains and every path that starts with theirs; the
longest wins. Hosts without a rule are judged by a second list, of blocked hosts, which takes in their subdomains. A page's keys are the
suffixes of its host with as many labels as a listed host has, for rules joined with the path's prefixes of the rules' lengths;
so keys a page are bounded by the lists, however many labels a host has.

Defined cases: a null url, or one without ://, has an empty host and path, no rule, and is allowed; urls of any length are read
whole; equal urls and repeated rows are judged alike; null and empty hosts in the lists fit nothing, as do empty lists; no rows give
no rows; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlake.llm.common import settle, text_of

#: Hash functions of a level; bits a key from the second level on; levels at most (each halves what is wrong, at least).
HASHES, LATER_BITS, LEVELS = 4, 6, 64
#: Rules of the query: (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Blocked hosts of the query where no list is given.
BLOCKED = tuple(f"{name}.example.{top}" for name in ("adult-x", "casino-win", "cheap-pills", "free-bets") for top in ("com", "net", "org"))
#: Words of a slice of a level (16 MB), and bits of a level at most (1 GB).
SLICE, MAX_BITS = 1 << 21, 1 << 33


def _bits(key: Column, level: int, size: int) -> Column:
    """The bit places of a key in a level of `size` bits."""
    hashes = [F.pmod(F.xxhash64(F.lit(level * HASHES + i), key), F.lit(size)) for i in range(HASHES)]
    return F.array(*hashes)


def _level(keys: DataFrame, level: int, size: int) -> list[DataFrame]:
    """The filter of the keys in slices of SLICE words, each one row with an array: a task gathers one slice at most."""
    words = keys.select(F.explode(_bits(F.col("key"), level, size)).alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    total = size // 64
    if total > SLICE:
        words = settle(words, "words")

    def one(start: int) -> DataFrame:
        own = keys.sparkSession.range(start, min(total, start + SLICE)).select(F.col("id").alias("word"))
        dense = own.join(words, "word", "left").select("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
        return settle(dense.agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("w")).select(F.transform("w", lambda x: x.bits).alias("words")), "level")

    return [one(start) for start in range(0, total, SLICE)]


class Cascade:
    """Exact membership of the listed keys over a universe of keys (both: one column `key`, distinct, settled)."""

    def __init__(self, listed: DataFrame, universe: DataFrame, most: int = MAX_BITS) -> None:
        self.levels: list[tuple[list[DataFrame], int]] = []
        self.joined: DataFrame | None = None
        # Listed keys that never occur need no bits.
        keys = settle(universe.join(listed.withColumn("_in", F.lit(True)), "key", "left").select("key", F.col("_in").isNotNull().alias("inside")), "keys")
        n, others = (int(x or 0) for x in keys.agg(F.sum(F.col("inside").cast("long")), F.sum((~F.col("inside")).cast("long"))).first())
        inside, outside = keys.where("inside").select("key"), keys.where("NOT inside").select("key")
        per_key = max(LATER_BITS, math.ceil(1.44 * math.log2(max(2, others / max(1, n)))))
        if n * per_key > most:
            self.joined = inside.withColumn("_in", F.lit(True))
            return
        while n and len(self.levels) < LEVELS:
            size = 64 * math.ceil(max(64, n * per_key) / 64)
            words = _level(inside, len(self.levels), size)
            self.levels.append((words, size))
            wrong = settle(outside.where(self._passes(len(self.levels) - 1, F.col("key"))), "wrong")
            inside, outside, n, per_key = wrong, inside, wrong.count(), LATER_BITS
        if n:
            raise ValueError("the cascade did not end")

    def _passes(self, level: int, key: Column) -> Column:
        slices, size = self.levels[level]
        held = [words.scalar() for words in slices]
        test = None
        for i in range(HASHES):
            bit = F.pmod(F.xxhash64(F.lit(level * HASHES + i), key), F.lit(size))
            word = F.shiftright(bit, 6)
            own = held[0]
            if len(held) > 1:
                own = F.when(word < SLICE, held[0])
                for k in range(1, len(held)):
                    own = own.when(word < (k + 1) * SLICE, held[k])
            hit = F.get(own, (word % SLICE).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))) != 0
            test = hit if test is None else test & hit
        return test

    def marked(self, rows: DataFrame, name: str) -> DataFrame:
        """rows (key, ...) with a boolean: whether the key, one of the universe, is listed. The first level that it fails tells by its place."""
        if self.joined is not None:
            return rows.join(self.joined, "key", "left").withColumn(name, F.col("_in").isNotNull()).drop("_in")
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            answer = F.when(~self._passes(level, F.col("key")), F.lit(level % 2 == 1)).otherwise(answer)
        return rows.withColumn(name, answer)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The contract's host and path; both empty where there is no ://."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def suffixes(host: Column, counts: list[int]) -> Column:
    """Array of the host's suffixes with so many labels, as far as it has them."""
    return F.filter(F.array(*(F.when((_labels(host) >= n) & (host != ""), F.substring_index(host, ".", -n)) for n in counts)).cast("array<string>"), lambda s: s.isNotNull())


def rule_keys(host: Column, path: Column, counts: list[int], lengths: list[int]) -> Column:
    """Array of the rule keys that could fit: suffixes of the host, joined with each prefix of the path."""
    prefixes = F.filter(F.array(*(F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths)).cast("array<string>"), lambda p: p.isNotNull())
    return F.flatten(F.transform(suffixes(host, counts), lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def decisions(pages: DataFrame, rules: DataFrame, blocked_hosts: DataFrame, id_col: str = "page_id", most: int = MAX_BITS) -> DataFrame:
    """pages (id, url), rules (host, path, verdict), blocked_hosts (host) -> id, host, path, rule, verdict."""
    host, path = host_and_path(F.col("url"))
    parts = pages.select(id_col, host.alias("host"), path.alias("path"))
    listed = settle(rules.where("host <> ''").select(F.lower("host").alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").select(F.concat("host", "path").alias("key"), "verdict", _labels(F.col("host")).alias("labels"), F.length("path").alias("length")), "rules")
    hosts = settle(blocked_hosts.where("host <> ''").select(F.lower("host").alias("key")).distinct().withColumn("labels", _labels(F.col("key"))), "blocked")
    distinct = lambda table, c: sorted(r[0] for r in table.select(c).distinct().collect())  # noqa: E731  a few small numbers
    keys = {
        "rule": rule_keys(F.col("host"), F.col("path"), distinct(listed, "labels"), distinct(listed, "length")),
        "host": suffixes(F.col("host"), distinct(hosts, "labels")),
    }
    universe = {kind: settle(parts.select(F.explode(array).alias("key")).groupBy("key").count().select("key"), "universe") for kind, array in keys.items()}
    # A page's keys are tested as rows of one task; the partial aggregate joins them again, so one row a page is shuffled.
    tag = lambda kind: lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key"))
    tagged = F.concat(*(F.transform(array, tag(kind)) for kind, array in keys.items()))
    tried = parts.withColumn("row", F.monotonically_increasing_id()).withColumn("_key", F.explode_outer(tagged)).select("row", id_col, "host", "path", "_key.kind", "_key.key")
    for verdict in ("allow", "block"):
        tried = Cascade(listed.where(F.col("verdict") == verdict).select("key").distinct(), universe["rule"], most).marked(tried, f"_{verdict}")
    tried = Cascade(hosts.select("key"), universe["host"], most).marked(tried, "_listed")
    fits = (F.col("kind") == "rule") & (F.col("_allow") | F.col("_block"))
    best = F.max(F.when(fits, F.struct(F.length("key").alias("n"), F.col("key").alias("rule"), F.when(F.col("_allow"), "allow").otherwise("block").alias("verdict"))))
    judged = tried.groupBy("row", id_col, "host", "path").agg(best.alias("best"), F.max((F.col("kind") == "host") & F.col("_listed")).alias("listed"))
    other = F.when(F.col("listed"), "block").otherwise("allow")
    return judged.select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", other).alias("verdict"))


def op5_url_filter(spark: SparkSession, sf_dir: str, blocked: DataFrame | None = None) -> DataFrame:
    """Judges pages by RULES and a table of blocked hosts (host); BLOCKED where none is given."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", text_of("url").alias("url"))
    rules = spark.sql("SELECT inline(array(" + ", ".join(f"struct('{h}' AS host, '{p}' AS path, '{v}' AS verdict)" for h, p, v in RULES) + "))")
    if blocked is None:
        blocked = spark.sql("SELECT explode(array(" + ", ".join(f"'{h}'" for h in BLOCKED) + ")) AS host")
    return decisions(pages, rules, blocked)


QUERIES = {"op5_url_filter": op5_url_filter}
SQL = {
    "op5_url_filter": rf"""
        WITH rest AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
        ), parts AS (
            SELECT page_id, translate(regexp_extract(coalesce(r, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(r, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM rest
        ), rules(rule_host, rule_path, rule_verdict) AS (
            VALUES {", ".join(str(r) for r in RULES)}
        ), blocked(blocked_host) AS (
            VALUES {", ".join(f"('{h}')" for h in BLOCKED)}
        ), fits AS (
            SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
                   arg_max(rule_verdict, length(rule_host || rule_path)) AS rule_verdict
            FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
            GROUP BY page_id
        )
        SELECT page_id, host, path, rule,
               coalesce(rule_verdict, CASE WHEN EXISTS (SELECT 1 FROM blocked WHERE host = blocked_host OR ends_with(host, '.' || blocked_host)) THEN 'block' ELSE 'allow' END) AS verdict
        FROM parts LEFT JOIN fits USING (page_id)
    """
}
