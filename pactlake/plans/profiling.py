"""Queries over profiling, inference, checks and drift, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlake.contract import Clause, Contract
from pactlake.functions.scalar import is_iso_datetime, is_uuid, uuid5
from pactlake.operators import checks, drift, infer, profile, sketches
from pactlake.sources import readers

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
STATS = """round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS stddev, round(min(v), 6) AS min, round(max(v), 6) AS max,
    round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.75), 6) AS p75,
    round(quantile_cont(v, 0.95), 6) AS p95, round(quantile_cont(v, 0.99), 6) AS p99"""
STAT_NAMES = ("mean", "stddev", "min", "max", "p25", "p50", "p75", "p95", "p99")


def stacked(table_name: str, columns: list[str], extra: str = "") -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c}::DOUBLE AS v{extra} FROM {table_name}" for c in columns)


@query(f'SELECT "column", {STATS} FROM ({stacked("lineitem", LINE)}) GROUP BY "column"')
def profile_numeric(spark, d):
    return rounded(profile.numeric(table(spark, d, "lineitem"), LINE), *STAT_NAMES)


NULLED = "SELECT nullif(o_orderstatus, 'P') AS o_orderstatus, nullif(o_orderpriority, '1-URGENT') AS o_orderpriority, o_totalprice, o_orderkey FROM orders"


@query(f"""
    WITH t AS ({NULLED})
    {" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS null_count, round((count(*) - count({c})) / count(*)::DOUBLE, 6) AS null_fraction FROM t" for c in ("o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderkey"))}
""")
def profile_nulls(spark, d):
    o = table(spark, d, "orders")
    rows = o.select(F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"), F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("o_orderpriority"), "o_totalprice", "o_orderkey")
    return rounded(profile.nulls(rows), "null_fraction")


PART = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS cardinality FROM part" for c in PART))
def profile_cardinality(spark, d):
    return profile.cardinality(table(spark, d, "part"), PART)


CUST = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", array_to_string((SELECT list(v ORDER BY v) FROM (SELECT DISTINCT {c}::VARCHAR AS v FROM customer ORDER BY v LIMIT 5)), '|') AS sample_values" for c in CUST))
def sample_values(spark, d):
    return profile.samples(table(spark, d, "customer"), CUST).select("column", F.array_join("sample_values", "|").alias("sample_values"))


def _part_clauses(spark, d):
    return infer.clause_rows(profile.profile(table(spark, d, "part").select(*PART)))


INFER_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{t}' AS type, count(*) = count({c}) AS required, CAST(NULL AS VARCHAR) AS format,
        {f"CASE WHEN min({c}) >= 0 THEN 0.0::DOUBLE END" if t != "string" else "CAST(NULL AS DOUBLE)"} AS minimum, CAST(NULL AS DOUBLE) AS maximum,
        {f"CASE WHEN count(DISTINCT {c}) BETWEEN 1 AND 5 THEN array_to_string(list_sort(list(DISTINCT {c})), ',') END" if t == "string" else "CAST(NULL AS VARCHAR)"} AS enum_values FROM part"""
    for c, t in zip(PART, ("integer", "string", "string", "string", "integer", "number"))
)


@query(INFER_SQL)
def infer_clauses(spark, d):
    return _part_clauses(spark, d).select("column", "type", "required", "format", "minimum", "maximum", F.array_join("enum", ",").alias("enum_values"))


@query("""
    SELECT 'o_orderstatus' AS "column", o_orderstatus AS value FROM orders WHERE (SELECT count(DISTINCT o_orderstatus) FROM orders) <= 5 GROUP BY o_orderstatus
    UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders WHERE (SELECT count(DISTINCT o_orderpriority) FROM orders) <= 5 GROUP BY o_orderpriority
    UNION ALL SELECT 'p_type', p_type FROM part WHERE (SELECT count(DISTINCT p_type) FROM part) <= 5 GROUP BY p_type
    UNION ALL SELECT 'p_brand', p_brand FROM part WHERE (SELECT count(DISTINCT p_brand) FROM part) <= 5 GROUP BY p_brand
    UNION ALL SELECT 'event_type', event_type FROM events WHERE (SELECT count(DISTINCT event_type) FROM events) <= 5 GROUP BY event_type
""")
def infer_enum(spark, d):
    out = None
    for t, cols in (("orders", ["o_orderstatus", "o_orderpriority"]), ("part", ["p_type", "p_brand"]), ("events", ["event_type"])):
        rows = infer.clause_rows(profile.profile(table(spark, d, t).select(*cols)).withColumns({s: F.lit(None).cast("double") for s in STAT_NAMES}))
        rows = rows.select("column", F.explode("enum").alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


WARN_SQL = f"""
    WITH v AS ({stacked("lineitem", LINE)} UNION ALL SELECT 'c_acctbal_score', c_acctbal::DOUBLE FROM customer UNION ALL SELECT 'flat', 1.0::DOUBLE FROM customer),
    s AS (SELECT "column", avg(v) AS mean, coalesce(stddev_samp(v), 0) AS stddev, min(v) AS min, max(v) AS max, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.99) AS p99, count(DISTINCT v) AS cardinality FROM v GROUP BY 1)
    SELECT "column", 'near_constant_high' AS code, 'WARN' AS severity FROM s WHERE max <= 1 AND mean > 0.99
    UNION ALL SELECT "column", 'near_constant_low', 'WARN' FROM s WHERE max <= 1 AND mean < 0.01
    UNION ALL SELECT "column", 'low_variance', 'WARN' FROM s WHERE stddev < 0.001 AND cardinality > 5
    UNION ALL SELECT "column", 'extreme_skew', 'WARN' FROM s WHERE p50 > 0 AND p99 > 10 * p50
    UNION ALL SELECT "column", 'unexpected_negatives', 'HIGH' FROM s WHERE min < 0 AND regexp_matches(lower("column"), '{"|".join(infer.NONNEGATIVE_HINTS)}')
"""


@query(WARN_SQL)
def distribution_warnings(spark, d):
    line = table(spark, d, "lineitem").select(*LINE)
    cust = table(spark, d, "customer").select(F.col("c_acctbal").alias("c_acctbal_score"), F.lit(1.0).alias("flat"))
    rows = profile.numeric(line).join(profile.cardinality(line), "column").unionByName(profile.numeric(cust).join(profile.cardinality(cust), "column"))
    return infer.warnings(rows)


@query("""
    SELECT 'doc_id' AS "column", (count(*) - count(doc_id))::BIGINT AS missing_count, (count(doc_id) - count(DISTINCT doc_id))::BIGINT AS duplicate_count FROM documents
    UNION ALL SELECT 'text', count(*) - count(text), count(text) - count(DISTINCT text) FROM documents
    UNION ALL SELECT 'source', count(*) - count(source), count(source) - count(DISTINCT source) FROM documents
""")
def soda_missing_duplicate(spark, d):
    return checks.missing_and_duplicates(table(spark, d, "documents"), ["doc_id", "text", "source"])


@query("""
    WITH h AS (SELECT *, l_orderkey % 2 AS half FROM lineitem),
    b AS (SELECT half, 'l_quantity' AS "column", avg(l_quantity) AS mean, stddev_samp(l_quantity) AS stddev FROM h GROUP BY half
          UNION ALL SELECT half, 'l_tax', avg(l_tax), stddev_samp(l_tax) FROM h WHERE half = 1 GROUP BY half)
    SELECT coalesce(o."column", n."column") AS "column", round(coalesce(o.mean, n.mean), 6) AS mean, round(coalesce(o.stddev, n.stddev), 6) AS stddev
    FROM (SELECT * FROM b WHERE half = 0) o FULL JOIN (SELECT * FROM b WHERE half = 1) n ON o."column" = n."column"
""")
def baselines_upsert(spark, d):
    line = table(spark, d, "lineitem")
    side = lambda half, cols: profile.numeric(line.where(F.col("l_orderkey") % 2 == half), cols).withColumn("contract_id", F.lit("lineitem"))
    return rounded(drift.upsert(side(0, ["l_quantity"]), side(1, ["l_quantity", "l_tax"])).select("column", "mean", "stddev"), "mean", "stddev")


def _checked(df, contract, kinds=None, baselines=None):
    rows = checks.validate(df, contract, baselines)
    rows = rows.where(F.col("check_type").isin(kinds)) if kinds else rows
    return rows.select("check_id", "check_type", "status", "actual_value", "severity", "records_failing")


@query(f"""
    WITH t AS ({NULLED})
    SELECT 'orders.o_orderstatus.required.no_nulls' AS check_id, 'required' AS check_type, CASE WHEN n > 0 THEN 'CRITICAL' ELSE 'PASS' END AS status,
           CASE WHEN n > 0 THEN printf('%d nulls (%.1f%%)', n, n * 100.0::DOUBLE / c) ELSE '0 nulls' END AS actual_value, 'CRITICAL' AS severity, n AS records_failing
    FROM (SELECT count(*) - count(o_orderstatus) AS n, count(*) AS c FROM t)
    UNION ALL SELECT 'orders.o_totalprice.required.no_nulls', 'required', 'PASS', '0 nulls', 'CRITICAL', 0
    UNION ALL SELECT 'orders.o_missing.required.present', 'required', 'CRITICAL', 'column missing entirely', 'CRITICAL', count(*) FROM t
""")
def check_required(spark, d):
    rows = table(spark, d, "orders").select(F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"), "o_totalprice")
    return _checked(rows, Contract("orders", {c: Clause(type="", required=True) for c in ("o_orderstatus", "o_totalprice", "o_missing")}))


@query("""
    SELECT * FROM (VALUES ('orders.o_orderkey.type_match', 'PASS', 'dtype=int64'), ('orders.o_totalprice.type_match', 'CRITICAL', 'dtype=float64'), ('orders.o_orderstatus.type_match', 'PASS', 'dtype=object'), ('orders.o_maybe.type_match', 'CRITICAL', 'dtype=float64')) t(check_id, status, actual_value)
""")
def check_type(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", F.when(F.col("o_orderkey") > 100, F.col("o_orderkey")).alias("o_maybe"))
    clauses = {"o_orderkey": "integer", "o_totalprice": "integer", "o_orderstatus": "string", "o_maybe": "integer"}
    return _checked(rows, Contract("orders", {c: Clause(type=t) for c, t in clauses.items()})).select("check_id", "status", "actual_value")


ENUM = ("click", "view", "signup", "purchase")


@query(f"""
    SELECT 'events.event_type.enum_conformance' AS check_id, 'enum' AS check_type, CASE WHEN n > 0 THEN 'CRITICAL' ELSE 'PASS' END AS status,
           CASE WHEN n > 0 THEN printf('%d non-conforming values', n) ELSE 'all values conforming' END AS actual_value, 'CRITICAL' AS severity,
           n AS records_failing, s AS sample_failing
    FROM (SELECT count(*) FILTER (event_type NOT IN {ENUM}) AS n, array_to_string(list_sort(list(DISTINCT event_type) FILTER (event_type NOT IN {ENUM}))[1:5], '|') AS s FROM events)
""")
def check_enum(spark, d):
    rows = checks.validate(table(spark, d, "events"), Contract("events", {"event_type": Clause(type="", enum=ENUM)}), samples=5)
    return rows.select("check_id", "check_type", "status", "actual_value", "severity", "records_failing", F.array_join("sample_failing", "|").alias("sample_failing"))


UUID5_SQL = """(lower(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::INT % 4) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)))"""
HASHED = "sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('doc:' || doc_id::VARCHAR))"


@query(f"""
    WITH u AS (SELECT doc_id, {UUID5_SQL} AS good FROM (SELECT doc_id, {HASHED} AS h FROM documents))
    SELECT 'documents.doc_id.uuid_pattern' AS check_id, 'CRITICAL' AS status, count(*) FILTER (NOT regexp_matches(doc_id::VARCHAR, '^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$', 'i')) AS records_failing FROM u
    UNION ALL SELECT 'documents.uuid.uuid_pattern', 'PASS', count(*) FILTER (NOT regexp_matches(good, '^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$', 'i')) FROM u
""")
def check_uuid(spark, d):
    rows = table(spark, d, "documents").select("doc_id", uuid5(F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))).alias("uuid"))
    return _checked(rows, Contract("documents", {c: Clause(type="", format="uuid") for c in ("doc_id", "uuid")})).select("check_id", "status", "records_failing")


@query(f"SELECT doc_id, {UUID5_SQL} AS uuid FROM (SELECT doc_id, {HASHED} AS h FROM documents)")
def uuid5_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", uuid5(F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))).alias("uuid"))


TS_TEXT = """CASE event_id % 6 WHEN 0 THEN {f1} WHEN 1 THEN {f2} WHEN 2 THEN {f3} WHEN 3 THEN concat({f1}, '+02:00') WHEN 4 THEN concat({f3}, ' at noon') ELSE concat({f3}, 'T25:00:00') END"""


@query(f"""
    SELECT 'events.ts.datetime_format' AS check_id, CASE WHEN n > 0 THEN 'CRITICAL' ELSE 'PASS' END AS status, n AS records_failing
    FROM (SELECT count(*) FILTER (event_id % 6 IN (1, 4, 5)) AS n FROM events)
""")
def check_datetime(spark, d):
    text = TS_TEXT.format(f1="date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")", f2="date_format(ts, 'yyyy/MM/dd')", f3="date_format(ts, 'yyyy-MM-dd')")
    rows = table(spark, d, "events").select("event_id", F.expr(text).alias("ts"))
    return _checked(rows, Contract("events", {"ts": Clause(type="", format="date-time")})).select("check_id", "status", "records_failing")


#: Texts by event: a pattern of Spark's date_format and of strftime, what follows, and whether it is an ISO 8601 time.
ISO_CASES = [("yyyy-MM-dd", "%Y-%m-%d", "", True), ("yyyyMMdd", "%Y%m%d", "", True), ("yyyy-MM-dd'T'HH", "%Y-%m-%dT%H", "", True), ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S", ".5Z", True), ("yyyy", "%Y", "-W01-1", True), ("yyyy-MM", "%Y-%m", "", False), ("yyyy", "%Y", "-02-30", False), ("yyyy-MM-dd'T'", "%Y-%m-%dT", "24:00:00", False), ("yyyy-MM-dd'T'HH", "%Y-%m-%dT%H", ":61", False), ("yyyy-MM-dd", "%Y-%m-%d", "x10:20", True), ("EEEE", "%A", "", False)]
_TEXT = lambda f, k: "CASE " + " ".join(f"WHEN event_id % {len(ISO_CASES)} = {i} THEN concat({f(c[k])}, '{c[2]}')" for i, c in enumerate(ISO_CASES)) + " END"


@query(f"SELECT event_id, {_TEXT(lambda p: f'strftime(ts, {p!r})', 1)} AS value, event_id % {len(ISO_CASES)} IN ({', '.join(str(i) for i, c in enumerate(ISO_CASES) if c[3])}) AS ok FROM events")
def iso_datetime(spark, d):
    cases = F.create_map(*(x for i, c in enumerate(ISO_CASES) for x in (F.lit(i), F.concat(F.date_format("ts", c[0]), F.lit(c[2])))))
    rows = table(spark, d, "events").select("event_id", F.element_at(cases, (F.col("event_id") % len(ISO_CASES)).cast("int")).alias("value"))
    return rows.select("event_id", "value", is_iso_datetime(F.col("value")).alias("ok"))


@query("""
    SELECT 'customer.c_acctbal.range' AS check_id, CASE WHEN n > 0 THEN 'HIGH' ELSE 'PASS' END AS status, printf('min=%.4f, max=%.4f', lo, hi) AS actual_value, n AS records_failing
    FROM (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi, count(*) FILTER (c_acctbal < 0) + count(*) FILTER (c_acctbal > 5000) AS n FROM customer)
""")
def check_range(spark, d):
    return _checked(table(spark, d, "customer"), Contract("customer", {"c_acctbal": Clause(type="", minimum=0.0, maximum=5000.0)})).select("check_id", "status", "actual_value", "records_failing")


@query(f"""
    WITH h AS (SELECT *, l_orderkey % 2 AS half FROM lineitem),
    m AS ({" UNION ALL ".join(f"SELECT '{c}' AS \"column\", avg({c}) FILTER (half = 0) AS base, stddev_samp({c}) FILTER (half = 0) AS sd, avg({c}) FILTER (half = 1) * {k} AS mean FROM h" for c, k in zip(LINE, (1, 2, 3, 5)))})
    SELECT "column", round(mean, 4) AS mean, round(base, 4) AS base_mean, round(abs(mean - base) / greatest(sd, 1e-9), 4) AS z_score,
           CASE WHEN abs(mean - base) / greatest(sd, 1e-9) > 3 THEN 'HIGH' WHEN abs(mean - base) / greatest(sd, 1e-9) > 2 THEN 'MEDIUM' ELSE 'PASS' END AS status, false AS first_run
    FROM m
""")
def check_drift(spark, d):
    line = table(spark, d, "lineitem")
    now = line.where("l_orderkey % 2 = 1").select(*((F.col(c) * k).alias(c) for c, k in zip(LINE, (1, 2, 3, 5))))
    out = drift.drift(profile.numeric(now).select("column", "mean"), profile.numeric(line.where("l_orderkey % 2 = 0"), LINE))
    return rounded(out, "mean", "base_mean", "z_score", digits=4)


LINE_CONTRACT = Contract(
    "lineitem",
    {
        "l_orderkey": Clause("integer", True, minimum=0.0),
        "l_quantity": Clause("number", True, minimum=0.0, maximum=40.0),
        "l_discount": Clause("number", True, minimum=0.0, maximum=1.0),
        "l_returnflag": Clause("string", True, enum=("A", "N")),
        "l_shipdate": Clause("string", True, format="date-time"),
        "l_comment": Clause("string", True),
    },
)
LINE_BASE = {"l_quantity": {"mean": 10.0, "stddev": 2.0}, "l_discount": {"mean": 0.05, "stddev": 0.03}}
FUSED_SQL = """
    WITH m AS (SELECT count(*) AS n, count(*) FILTER (l_quantity > 40) AS q, count(*) FILTER (l_returnflag NOT IN ('A', 'N')) AS e FROM lineitem),
    z(c, z, b) AS (SELECT 'l_quantity', abs(avg(l_quantity) - 10.0) / 2.0, 'z_score <= 2 (baseline mean=10.0000)' FROM lineitem UNION ALL SELECT 'l_discount', abs(avg(l_discount) - 0.05) / 0.03, 'z_score <= 2 (baseline mean=0.0500)' FROM lineitem),
    d AS (SELECT c, b, CASE WHEN z > 3 THEN 'HIGH' WHEN z > 2 THEN 'MEDIUM' ELSE 'PASS' END AS s FROM z),
    t(c, t) AS (VALUES ('l_orderkey', 'integer'), ('l_quantity', 'number'), ('l_discount', 'number'), ('l_returnflag', 'string'), ('l_shipdate', 'string'))
    SELECT 'lineitem.' || c || '.required.no_nulls' AS check_id, 'required' AS check_type, 'PASS' AS status, 'CRITICAL' AS severity, 'null_count = 0' AS expected, 0::BIGINT AS records_failing FROM t
    UNION ALL SELECT 'lineitem.l_comment.required.present', 'required', 'CRITICAL', 'CRITICAL', 'column present with 0 nulls', n FROM m
    UNION ALL SELECT 'lineitem.' || c || '.type_match', 'type', 'PASS', 'CRITICAL', 'type=' || t, 0 FROM t
    UNION ALL SELECT 'lineitem.l_returnflag.enum_conformance', 'enum', CASE WHEN e > 0 THEN 'CRITICAL' ELSE 'PASS' END, 'CRITICAL', 'all values in [''A'', ''N'']', e FROM m
    UNION ALL SELECT 'lineitem.l_shipdate.datetime_format', 'datetime_format', 'PASS', 'CRITICAL', 'ISO 8601 date-time', 0
    UNION ALL SELECT 'lineitem.l_orderkey.range', 'range', 'PASS', 'HIGH', 'min>=0.0, max<=+inf', 0
    UNION ALL SELECT 'lineitem.l_quantity.range', 'range', CASE WHEN q > 0 THEN 'HIGH' ELSE 'PASS' END, 'HIGH', 'min>=0.0, max<=40.0', q FROM m
    UNION ALL SELECT 'lineitem.l_discount.range', 'range', 'PASS', 'HIGH', 'min>=0.0, max<=1.0', 0
    UNION ALL SELECT 'lineitem.' || c || '.statistical_drift', 'statistical_drift', 'PASS', 'HIGH', 'baseline established (first run)', 0 FROM (VALUES ('l_orderkey'), ('l_partkey'), ('l_suppkey'), ('l_linenumber'), ('l_extendedprice'), ('l_tax')) t(c)
    UNION ALL SELECT 'lineitem.' || c || '.statistical_drift', 'statistical_drift', s, s, b, 0 FROM d
"""


def _fused(spark, d):
    return checks.validate(table(spark, d, "lineitem"), LINE_CONTRACT, LINE_BASE)


@query(FUSED_SQL)
def validate_fused(spark, d):
    return _fused(spark, d).select("check_id", "check_type", "status", "severity", "expected", "records_failing")


COUNTERS_SQL = f"""SELECT count(*) AS total_checks, count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'FAIL') AS failed, count(*) FILTER (status IN ('WARNING', 'MEDIUM')) AS warned,
    count(*) FILTER (status = 'HIGH') AS high, count(*) FILTER (status = 'CRITICAL') AS critical, count(*) FILTER (status = 'ERROR') AS errored FROM ({FUSED_SQL})"""


@query(COUNTERS_SQL)
def report_counters(spark, d):
    return checks.counters(_fused(spark, d))


@query(f"""
    SELECT mode, CASE mode WHEN 'ENFORCE' THEN critical + high > 0 WHEN 'WARN' THEN critical > 0 ELSE false END AS blocked
    FROM ({COUNTERS_SQL}) c, (VALUES ('AUDIT'), ('WARN'), ('ENFORCE')) m(mode)
""")
def gate_modes(spark, d):
    rows = checks.counters(_fused(spark, d)).select("*", F.explode(F.array(*map(F.lit, ("AUDIT", "WARN", "ENFORCE")))).alias("mode"))
    return rows.select("mode", checks.blocks(F.col("mode"), F.col("critical"), F.col("high")).alias("blocked"))


@query("""
    WITH b AS (SELECT count(*) FILTER (o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) AS n, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS s FROM orders)
    SELECT 'orders.o_custkey.enum_conformance' AS check_id, CASE WHEN n > 0 THEN 'CRITICAL' ELSE 'PASS' END AS status, CASE WHEN n > 0 THEN printf('%d non-conforming values', n) ELSE 'all values conforming' END AS actual_value, n AS records_failing FROM b
    UNION ALL SELECT 'orders.o_orderstatus.enum_conformance', CASE WHEN s > 0 THEN 'CRITICAL' ELSE 'PASS' END, CASE WHEN s > 0 THEN printf('%d non-conforming values', s) ELSE 'all values conforming' END, s FROM b
""")
def check_enum_table(spark, d):
    """A column's agreed values are a column of another table; a short list stands in the contract."""
    listed = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("value"))
    contract = Contract("orders", {"o_custkey": Clause(type=""), "o_orderstatus": Clause(type="", enum=("F", "O"))})
    return checks.validate(table(spark, d, "orders"), contract, lists={"o_custkey": listed}).select("check_id", "status", "actual_value", "records_failing")


@query("""
    WITH g AS (SELECT *, event_id % 10 = 3 AS bad FROM events)
    SELECT 'events.__file__.load' AS check_id, 'ERROR' AS status, 'CRITICAL' AS severity, count(*) AS records_failing FROM g WHERE bad
    UNION ALL SELECT 'events.event_type.enum_conformance', CASE WHEN count(*) FILTER (event_type NOT IN ('click', 'view', 'signup', 'purchase')) > 0 THEN 'CRITICAL' ELSE 'PASS' END, 'CRITICAL', count(*) FILTER (event_type NOT IN ('click', 'view', 'signup', 'purchase')) FROM g WHERE NOT bad
    UNION ALL SELECT 'events.event_id.required.no_nulls', 'PASS', 'CRITICAL', 0
""")
def check_kept_lines(spark, d):
    """Events as lines of JSON, of which every tenth is cut off: bad lines are counted, good ones are checked, in one aggregation."""
    text = F.to_json(F.struct("event_id", "event_type"))
    lines = table(spark, d, "events").select(F.when(F.col("event_id") % 10 == 3, F.substring(text, 1, 12)).otherwise(text).alias("value"))
    rows = readers.parsed(lines, "event_id long, event_type string")
    contract = Contract("events", {"event_id": Clause(type="", required=True), "event_type": Clause(type="", enum=("click", "view", "signup", "purchase"))})
    return checks.validate(rows, contract, corrupt=readers.CORRUPT).select("check_id", "status", "severity", "records_failing")


@query(f"""
    WITH v AS ({stacked("lineitem", LINE)})
    SELECT "column", count(v) AS n, 0::BIGINT AS missing, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS stddev, min(v) AS min, max(v) AS max, true AS quantiles_hold, true AS distinct_holds FROM v GROUP BY 1
""")
def merged_baselines(spark, d):
    """States of seven parts of a table, merged: exact where they say so, and sketches within their stated errors of the whole."""
    line = table(spark, d, "lineitem")
    found = sketches.merged(*(sketches.state(line.where(f"l_linenumber = {k}"), "lineitem", LINE) for k in range(1, 8)))
    out = sketches.profile_of(found).join(found.select("contract_id", "column", "missing"), ["contract_id", "column"])
    told = {r["column"]: r for r in out.collect()}  # a row a column
    at = lambda c, p: told[c][p]
    ranks = line.agg(*(F.struct(F.avg((F.col(c) < at(c, p)).cast("double")).alias("below"), F.avg((F.col(c) <= at(c, p)).cast("double")).alias("upto")).alias(f"{c}:{p}") for c in LINE for p in profile.QUANTILES), *(F.count_distinct(c).alias(c) for c in LINE)).first()
    holds = lambda c: all(ranks[f"{c}:{p}"].below - sketches.RANK_ERROR <= q <= ranks[f"{c}:{p}"].upto + sketches.RANK_ERROR for p, q in profile.QUANTILES.items())
    near = lambda c: abs(told[c].cardinality - ranks[c]) <= sketches.DISTINCT_ERROR * ranks[c]
    judged = F.create_map(*(x for c in LINE for x in (F.lit(c), F.struct(F.lit(holds(c)).alias("q"), F.lit(near(c)).alias("d")))))
    return rounded(out, "mean", "stddev").select("column", "n", "missing", "mean", "stddev", "min", "max", F.element_at(judged, F.col("column"))["q"].alias("quantiles_hold"), F.element_at(judged, F.col("column"))["d"].alias("distinct_holds"))


def _flagship_sql() -> str:
    """What holds of a table against the contract that is inferred from it, column by column."""
    kinds = {"event_id": "int64", "ts": "object", "user_id": "int64", "event_type": "object", "value": "float64", "props": "object"}
    row = lambda c, check, kind, actual, level, when="true", bad="0": f"SELECT 'events.{c}.{check}' AS check_id, '{kind}' AS check_type, CASE WHEN n > 0 THEN '{level}' ELSE 'PASS' END AS status, {actual} AS actual_value, '{level}' AS severity, n AS records_failing FROM (SELECT ({bad})::BIGINT AS n, * FROM p_{c}) WHERE {when}"
    ctes, rows = [], []
    for c, dtype in kinds.items():
        number = dtype != "object"
        ctes.append(f"p_{c} AS (SELECT count(*) AS rows, count({c}) AS present, count(DISTINCT {c}) AS card" + (f", min({c}) AS lo, max({c}) AS hi, avg({c}) AS mean, stddev_samp({c}) AS sd" if number else "") + " FROM events)")
        rows.append(row(c, "required.no_nulls", "required", "'0 nulls'", "CRITICAL", "rows = present"))
        rows.append(row(c, "type_match", "type", f"CASE WHEN rows > present AND '{dtype}' = 'int64' THEN 'dtype=float64' ELSE 'dtype={dtype}' END", "CRITICAL"))
        if c.endswith("_id"):
            rows.append(row(c, "uuid_pattern", "uuid_pattern", "CASE WHEN n > 0 THEN printf('%d values fail UUID regex', n) ELSE 'all values match UUID pattern' END", "CRITICAL", bad="present"))
        elif c == "ts":
            rows.append(row(c, "datetime_format", "datetime_format", "'all values parse as ISO 8601'", "CRITICAL"))
        elif not number:
            rows.append(row(c, "enum_conformance", "enum", "'all values conforming'", "CRITICAL", "card BETWEEN 1 AND 5"))
        if number:
            rows.append(row(c, "range", "range", "printf('min=%.4f, max=%.4f', lo::DOUBLE, hi::DOUBLE)", "HIGH", "lo >= 0"))
            rows.append(row(c, "statistical_drift", "statistical_drift", "printf('mean=%.4f, stddev=%.4f', mean, sd)", "HIGH", "present >= 2"))
    return "WITH " + ", ".join(ctes) + " " + " UNION ALL ".join(rows)


@query(_flagship_sql())
def infer_then_validate(spark, d):
    """The flagship: infer a contract from a table, then hold the table against it."""
    events = table(spark, d, "events")
    return _checked(events, infer.infer(events, "events"), baselines={})
