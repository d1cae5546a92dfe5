"""Secrets by patterns, and multipart credentials by linking their parts.

Patterns find assignments, access keys and long hexadecimal strings in whole texts. Besides them there are weak candidates that
mean little by themselves: identifiers (user names, client ids), secrets (opaque tokens of mixed letters and digits, short
passwords) and endpoints (urls, hosts). A weak candidate is reported only where complementary parts stand within REACH code
points of it in the same scope, a run of lines without a blank one: an identifier beside a secret, a secret beside an identifier,
an endpoint beside both. What the patterns found counts as a part too: access keys as identifiers, assignments and hexadecimal
strings with a letter as secrets.

The link is an interval join: parts are dealt to the buckets of REACH code points that they cover, summed up there to the least
start and the greatest end of each kind of part, and a weak candidate asks its own buckets and the next ones. So rows grow with the
parts, never with their pairs, however dense a document is. Places of matches come from the lengths of the pieces between
them, added up by a window over slim rows; texts are read once and never shuffled.

Defined cases: null text counts as empty and has no spans; offsets are code points; texts of any length are scanned whole; a weak
candidate that overlaps a find of the patterns is none; equal texts and repeated rows have equal spans; a null id stays null; no
rows give no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pactlake.llm.common import settle, text_of

#: Kinds in the order in which spans of one start are listed; the first three are the patterns'.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
BASE = KINDS[:3]
ASSIGN, ACCESS, HEX, IDENTIFIER, SECRET, ENDPOINT, BREAK = range(7)
#: Code points between parts of a credential at most; least lengths: an assigned value, a weak one, an access key, a hexadecimal string, an opaque token.
REACH, LEAST_VALUE, LEAST_WEAK, LEAST_ACCESS, LEAST_HEX, LEAST_TOKEN = 400, 12, 4, 18, 16, 20
_IS = r"[\"']?\x20*[:=]\x20*[\"']?"
_NAMES = {ASSIGN: ("password", "passwd", "secret", "token", "api_?key"), IDENTIFIER: ("access_?key_?id", "client_?id", "account", "username", "user", "login"), ENDPOINT: ("endpoint", "hostname", "host", "server")}
_SCHEMES = r"(?:https?|wss?|ftp|postgres|postgresql|mysql|mongodb|redis|amqps?)://[^\x09-\x0D\x20\"'<>]+"
_VALUE = r"[A-Za-z0-9+/_.=-]+"


def _any_case(names: tuple[str, ...]) -> str:
    """An alternation of names, letters in either case, as classes, so that no other alphabet's letters fold into them."""
    return "(?:" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in n) for n in names) + ")"


#: Patterns whose matches are leftmost and don't overlap. Runs are possessive where the pattern ends with them.
PATTERNS = {
    ASSIGN: f"{_any_case(_NAMES[ASSIGN])}{_IS}{_VALUE}+",
    ACCESS: r"AKIA[A-Z0-9]++",
    HEX: r"(?<![0-9a-f])[0-9a-f]{16,}+",
    IDENTIFIER: rf"{_any_case(_NAMES[IDENTIFIER])}{_IS}[A-Za-z0-9._@+-]{{3,}}+|A(?:SIA|IDA|ROA)[A-Z0-9]{{12,}}+",
    SECRET: r"(?<![A-Za-z0-9+/_.:@-])[A-Za-z0-9+/_-]{20,}+",
    ENDPOINT: rf"{_SCHEMES}+|{_any_case(_NAMES[ENDPOINT])}{_IS}[A-Za-z0-9.:-]{{3,}}+",
    BREAK: r"\n[\x09-\x0D\x20]*\n",
}
#: What a match begins with: tried first, as alternatives are slow to try at every letter.
_AHEAD = {ASSIGN: "(?=[AaPpSsTt])", IDENTIFIER: "(?=[AaCcLlUu])", ENDPOINT: "(?=[AaEeFfHhMmPpRrSsWw])"}
_FOUND = "array<struct<kind: int, place: int, gap: int, n: int, base: boolean, part: int>>"


def _value_length(match: Column) -> Column:
    return F.length(F.regexp_extract(match, f"^{_any_case(_NAMES[ASSIGN])}{_IS}({_VALUE})$", 1))


def _judged(kind: int, m: Column) -> tuple[Column, Column]:
    """Whether a match is a find of the patterns; the part that it can be, null if none."""
    nothing, part = F.lit(None).cast("int"), lambda ok, p: F.when(ok, F.lit(p)).cast("int")
    if kind == ASSIGN:
        return _value_length(m) >= LEAST_VALUE, part(_value_length(m) >= LEAST_WEAK, SECRET)
    if kind == ACCESS:
        return F.length(m) >= LEAST_ACCESS, part(F.length(m) >= LEAST_ACCESS, IDENTIFIER)
    if kind == HEX:
        return F.lit(True), part(m.rlike("[a-f]"), SECRET)
    if kind == SECRET:
        return F.lit(False), part(m.rlike("[0-9]") & m.rlike("[a-z]") & m.rlike("[A-Z]"), SECRET)
    return F.lit(False), nothing if kind == BREAK else F.lit(kind).cast("int")


def _matches(text: str, found: str, kind: int) -> Column:
    """The found matches in order, each with the code points between it and the one before; texts are cut only where there are any."""

    def one(m: Column, gap: Column) -> Column:
        base, part = _judged(kind, m)
        return F.struct(F.lit(kind).alias("kind"), F.length(gap).alias("gap"), F.length(m).alias("n"), base.alias("base"), part.alias("part"))

    zipped = F.zip_with(found, F.split(text, _pattern(kind), -1), lambda m, gap: F.when(m.isNotNull(), one(m, gap)))
    placed = F.transform(zipped, lambda x, i: F.struct(x.kind.alias("kind"), i.alias("place"), x.gap.alias("gap"), x.n.alias("n"), x.base.alias("base"), x.part.alias("part")))
    return F.when(F.size(found) > 0, F.filter(placed, lambda x: x.kind.isNotNull()).cast(_FOUND)).otherwise(F.array().cast(_FOUND))


def _pattern(kind: int) -> str:
    return _AHEAD[kind] + f"(?:{PATTERNS[kind]})" if kind in _AHEAD else PATTERNS[kind]


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Settled (row, doc_id, found): each document's matches; weak candidates only where the document has an identifier and a secret.

    A text without identifiers is not searched for other weak candidates."""
    named = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    found = lambda k: F.regexp_extract_all("text", F.lit(_pattern(k)), F.lit(0))
    rest = (SECRET, ENDPOINT, BREAK)
    named = named.select("*", *(found(k).alias(f"m{k}") for k in (ASSIGN, ACCESS, HEX, IDENTIFIER)))
    has_id = (F.size(f"m{IDENTIFIER}") > 0) | (F.size(f"m{ACCESS}") > 0)
    named = named.select("*", *(F.when(has_id, found(k)).otherwise(F.array().cast("array<string>")).alias(f"m{k}") for k in rest))
    each = named.select("row", "doc_id", *(_matches("text", f"m{k}", k).alias(f"k{k}") for k in PATTERNS))
    has = lambda part, *kinds: F.exists(F.concat(*(F.col(f"k{k}") for k in kinds)), lambda x: x.part == part)
    weak = has(IDENTIFIER, ACCESS, IDENTIFIER) & has(SECRET, ASSIGN, HEX, SECRET)
    kept = [F.when(weak | F.exists(f"k{k}", lambda x: x.base), F.col(f"k{k}")).otherwise(F.array().cast(_FOUND)) for k in range(len(BASE))]
    kept += [F.when(weak, F.col(f"k{k}")).otherwise(F.array().cast(_FOUND)) for k in range(len(BASE), BREAK + 1)]
    return settle(each.select("row", "doc_id", F.concat(*kept).alias("found")), "found")


def spans_of(found: DataFrame) -> DataFrame:
    """(row, found) -> settled (row, scope, kind, start, end, base, part): finds of the patterns, and weak candidates that overlap none."""
    each = found.select("row", F.explode("found").alias("m")).select("row", "m.*")
    ends = F.sum(F.col("gap").cast("long") + F.col("n")).over(Window.partitionBy("row", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    placed = each.withColumn("end", ends).withColumn("start", F.col("end") - F.col("n"))
    ahead = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    behind = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    scope = F.sum((F.col("kind") == BREAK).cast("int")).over(ahead)
    seen = placed.withColumn("scope", scope).withColumn("reached", F.max(F.when(F.col("base"), F.col("end"))).over(ahead)).withColumn("begins", F.min(F.when(F.col("base"), F.col("start"))).over(behind))
    free = F.col("part").isNotNull() & (F.coalesce("reached", F.lit(0)) <= F.col("start")) & (F.coalesce("begins", "end") >= F.col("end"))
    kind = F.when((F.col("kind") == ASSIGN) & ~F.col("base"), F.lit(SECRET)).otherwise(F.col("kind"))
    return settle(seen.where(F.col("base") | free).select("row", "scope", kind.alias("kind"), "start", "end", "base", "part"), "spans")


def linked(spans: DataFrame, reach: int = REACH) -> DataFrame:
    """Weak candidates (row, kind, start, end) that have their complementary parts within reach in their scope."""
    at, end = F.col("bucket") * reach, (F.col("bucket") + 1) * reach
    covered = F.sequence(F.floor(F.col("start") / reach), F.floor((F.col("end") - 1) / reach))
    pieces = spans.where("part IS NOT NULL").withColumn("bucket", F.explode(covered)).withColumn("from", F.greatest("start", at)).withColumn("to", F.least("end", end))
    parts = pieces.where(F.col("part") != ENDPOINT).groupBy("row", "scope", "bucket", "part").agg(F.min("from").alias("least"), F.max("to").alias("most"))
    asks = pieces.where("NOT base").select("row", "scope", "kind", "start", "end", "from", "to", F.col("bucket").alias("own"), F.explode(F.array(*(F.col("bucket") + i for i in (-1, 0, 1)))).alias("bucket"))
    met = asks.join(parts, ["row", "scope", "bucket"]).where((F.col("part") != F.col("kind")) & (F.when(F.col("bucket") > F.col("own"), F.col("least") - F.col("to")).when(F.col("bucket") < F.col("own"), F.col("from") - F.col("most")).otherwise(0) <= reach))
    both = met.groupBy("row", "kind", "start", "end").agg(F.max((F.col("part") == IDENTIFIER)).alias("identifier"), F.max((F.col("part") == SECRET)).alias("secret"))
    return both.where(F.when(F.col("kind") == ENDPOINT, F.col("identifier") & F.col("secret")).otherwise(True)).select("row", "kind", "start", "end")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """One row per document: doc_id, spans (start, kind, end, base) in order of start and kind; kind is a place in KINDS."""
    found = scanned(docs, id_col, text_col)
    spans = spans_of(found.where(F.size("found") > 0))
    every = spans.where("base").select("row", "kind", "start", "end", "base").unionByName(linked(spans, reach).withColumn("base", F.lit(False)))
    gathered = every.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "base"))).alias("spans"))
    none = F.array().cast("array<struct<start: long, kind: int, end: long, base: boolean>>")
    return found.select("row", "doc_id").join(gathered, "row", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """The query's columns of found spans."""
    name = lambda kind: F.element_at(F.array(*map(F.lit, KINDS)), kind + 1)
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s.kind), s.start.cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s.base)
    count = lambda k: F.size(F.filter(base, lambda s: s.kind == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *map(count, range(len(BASE))), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


#: As the oracle's patterns have neither look-behinds nor possessive runs: whole runs are taken and judged afterwards.
_PLAIN = PATTERNS | {
    ASSIGN: f"{_any_case(_NAMES[ASSIGN])}{_IS}{_VALUE}",
    ACCESS: "AKIA[A-Z0-9]+",
    HEX: "[0-9a-f]+",
    IDENTIFIER: PATTERNS[IDENTIFIER].replace("}+", "}"),
    SECRET: "[A-Za-z0-9+/_.:@-]+",
    ENDPOINT: PATTERNS[ENDPOINT].replace("++", "+").replace("}+", "}"),
}
_KIND_SQL = "\nUNION ALL\n".join(f"SELECT r, {k} AS kind, regexp_extract_all(t, {_quoted(p)}) AS m, regexp_split_to_array(t, {_quoted(p)}) AS g FROM docs" for k, p in _PLAIN.items())
_NAME_SQL = "['" + "', '".join(KINDS) + "'][kind + 1]"

QUERIES = {"op12_secrets": op12_secrets}
SQL = {
    "op12_secrets": f"""
        WITH docs AS (
            SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
        ), raw AS ({_KIND_SQL}), cut AS (
            SELECT r, kind, m, g, unnest(range(1, len(m) + 1)) AS i FROM raw WHERE len(m) > 0
        ), sized AS (
            SELECT r, kind, i, m[i] AS whole, length(g[i]) AS gap, length(m[i]) AS n FROM cut
        ), placed AS (
            SELECT r, kind, sum(gap + n) OVER (PARTITION BY r, kind ORDER BY i) - n AS start,
                   CASE WHEN kind = {SECRET} THEN regexp_extract(whole, '^[A-Za-z0-9+/_-]+') ELSE whole END AS said,
                   CASE WHEN kind = {ASSIGN} THEN length(regexp_extract(whole, {_quoted(f"^{_any_case(_NAMES[ASSIGN])}{_IS}({_VALUE})$")}, 1)) ELSE 0 END AS value
            FROM sized
        ), judged AS (
            SELECT r, kind, CAST(start AS BIGINT) AS start, CAST(start + length(said) AS BIGINT) AS stop,
                   (kind = {ASSIGN} AND value >= {LEAST_VALUE}) OR (kind = {ACCESS} AND length(said) >= {LEAST_ACCESS}) OR (kind = {HEX} AND length(said) >= {LEAST_HEX}) AS base,
                   CASE WHEN kind = {ASSIGN} AND value >= {LEAST_WEAK} THEN {SECRET}
                        WHEN kind = {ACCESS} AND length(said) >= {LEAST_ACCESS} THEN {IDENTIFIER}
                        WHEN kind = {HEX} AND length(said) >= {LEAST_HEX} AND regexp_matches(said, '[a-f]') THEN {SECRET}
                        WHEN kind = {SECRET} AND length(said) >= {LEAST_TOKEN} AND regexp_matches(said, '[0-9]') AND regexp_matches(said, '[a-z]') AND regexp_matches(said, '[A-Z]') THEN {SECRET}
                        WHEN kind IN ({IDENTIFIER}, {ENDPOINT}) THEN kind END AS part
            FROM placed
        ), breaks AS (
            SELECT r, start FROM judged WHERE kind = {BREAK}
        ), spans AS (
            SELECT j.r, CASE WHEN j.kind = {ASSIGN} AND NOT base THEN {SECRET} ELSE j.kind END AS kind, j.start, stop, base, part,
                   (SELECT count(*) FROM breaks AS b WHERE b.r = j.r AND b.start < j.start) AS scope
            FROM judged AS j
            WHERE base OR (part IS NOT NULL AND NOT EXISTS (SELECT 1 FROM judged AS b WHERE b.base AND b.r = j.r AND b.start < j.stop AND j.start < b.stop))
        ), tied AS (
            SELECT w.r, w.kind, w.start, w.stop, bool_or(p.part = {IDENTIFIER}) AS identifier, bool_or(p.part = {SECRET}) AS secret
            FROM spans AS w JOIN spans AS p ON p.r = w.r AND p.scope = w.scope AND p.part <> w.kind AND p.part <> {ENDPOINT}
                 AND p.start - w.stop <= {REACH} AND w.start - p.stop <= {REACH}
            WHERE NOT w.base GROUP BY ALL
        ), every AS (
            SELECT r, kind, start, stop, base FROM spans WHERE base
            UNION ALL SELECT r, kind, start, stop, false FROM tied WHERE kind <> {ENDPOINT} OR (identifier AND secret)
        ), told AS (
            SELECT r, count(*) FILTER (base AND kind = {ASSIGN}) AS n_assign, count(*) FILTER (base AND kind = {ACCESS}) AS n_access, count(*) FILTER (base AND kind = {HEX}) AS n_hex,
                   string_agg({_NAME_SQL} || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (base) AS base,
                   string_agg({_NAME_SQL} || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans
            FROM every GROUP BY r
        )
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
               sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM docs LEFT JOIN told USING (r)
    """
}
