"""Queries over reshaping, evolution, registries, lineage, blame, text, ETL and reports, each with its SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from pactlake.contract import Clause, Contract
from pactlake.functions import scalar
from pactlake.operators import blame, checks, etl, evolution, flatten, infer, lineage, profile, prompts, registry, report, text
from pactlake.operators.substrings import contains_join
from pactlake.plans.profiling import query, rounded, table
from pactlake.streaming.sequences import drained, sequence_breaks
from pactlake.streaming.validation import windowed_rate


SQL_OF_DRIFT = """
    WITH c AS (SELECT label % 2 AS side, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT side, pos, avg(x) AS m FROM c GROUP BY 1, 2),
    r AS (SELECT sum(a.m * b.m) / (sqrt(sum(a.m * a.m)) * sqrt(sum(b.m * b.m))) AS sim FROM m a JOIN m b ON a.pos = b.pos AND a.side = 0 AND b.side = 1)
    SELECT round(sim, 4) AS similarity, round(1 - sim, 4) AS drift, CASE WHEN round(1 - sim, 4) <= 0.15 THEN 'PASS' ELSE 'WARN' END AS status FROM r
"""
SQL_OF_RATE = """
    WITH v AS (SELECT CASE WHEN quality IS NULL THEN NULL WHEN quality * 3 >= 3 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM documents LEFT JOIN labels USING (doc_id))
    SELECT count(*) AS outputs, count(*) FILTER (verdict IS NULL) AS violations, round(count(*) FILTER (verdict IS NULL) / count(*)::DOUBLE, 4) AS rate,
           CASE WHEN count(*) FILTER (verdict IS NULL) / count(*)::DOUBLE > 0.02 THEN 'WARN' ELSE 'PASS' END AS status,
           CASE WHEN count(*) FILTER (verdict IS NULL) / count(*)::DOUBLE > 1.5 * 0.1 THEN 'rising' ELSE 'stable' END AS trend FROM v
"""


@query("""
    WITH g AS (SELECT conv_id, list({'turn': turn, 'role': role, 'text': text} ORDER BY turn) AS items FROM conversations GROUP BY conv_id),
    every AS (SELECT conv_id, items FROM g UNION ALL SELECT -1, [])
    SELECT conv_id, x.turn AS item_turn, x.role AS item_role, x.text AS item_text FROM (SELECT conv_id, unnest(CASE WHEN len(items) = 0 THEN [NULL] ELSE items END) AS x FROM every)
""")
def flatten_explode(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("items"))
    empty = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.array().cast(rows.schema["items"].dataType).alias("items"))
    return flatten.flatten(rows.unionByName(empty))


@query("""
    SELECT event_id, event_type AS item_type, user_id::VARCHAR AS item_n, NULL AS item_value FROM events WHERE event_id % 4 = 0
    UNION ALL SELECT event_id, NULL, NULL, user_id::VARCHAR FROM events WHERE event_id % 4 = 0
    UNION ALL SELECT event_id, NULL, NULL, event_type FROM events WHERE event_id % 4 = 1
    UNION ALL SELECT event_id, NULL, NULL, NULL FROM events WHERE event_id % 4 = 2
    UNION ALL SELECT event_id, NULL, CASE k WHEN 1 THEN event_type END, NULL FROM events, (SELECT unnest([1, 2, 3]) AS k) WHERE event_id % 4 = 3
""")
def flatten_mixed(spark, d):
    """Lines of JSON whose arrays hold objects, scalars, arrays and nulls side by side."""
    event, user = F.col("event_type"), F.col("user_id").cast("string")
    items = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('[{"type":"'), event, F.lit('","n":'), user, F.lit("},"), user, F.lit("]")))
    items = items.when(F.col("event_id") % 4 == 1, F.concat(F.lit('["'), event, F.lit('"]'))).when(F.col("event_id") % 4 == 2, "[]").otherwise(F.concat(F.lit('[{"n":"'), event, F.lit('"},[1],null]')))
    lines = table(spark, d, "events").select(F.concat(F.lit('{"event_id":'), F.col("event_id").cast("string"), F.lit(',"items":'), items, F.lit("}")).alias("line"))
    return flatten.flatten_variant(lines.select(F.parse_json("line").alias("v")), "v")


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_scalar(spark, d):
    return table(spark, d, "events").select("event_id", flatten.scalar_or_null(F.parse_json(F.get_json_object("props", "$.k")), "bigint").alias("k"))


@query("SELECT n_nationkey, n_name FROM nation")
def drop_all_null(spark, d):
    rows = table(spark, d, "nation").select("n_nationkey", "n_name", F.nullif(F.lit("x"), F.lit("x")).alias("nothing"))
    return flatten.drop_empty_columns(rows)


#: Fields of two versions of a contract on lineitem, the first three lines of an order and the others: name, and on either side
#: (expression, type, format) or None; the expressions are SQL of both engines.
FIELDS = [
    ("confidence", ("l_discount", "number", None), ("CAST(l_discount * 100 AS INT)", "integer", None)),
    ("amount", ("l_extendedprice - 10000000", "number", None), ("l_extendedprice", "number", None)),
    ("depth", ("l_quantity", "number", None), ("l_quantity - 1000", "number", None)),
    ("line", ("l_linenumber", "integer", None), ("CAST(l_linenumber AS DOUBLE)", "number", None)),
    ("flag", ("l_returnflag", "string", None), ("CASE l_returnflag WHEN 'R' THEN 'X' ELSE l_returnflag END", "string", None)),
    ("state", ("l_linestatus", "string", None), ("CONCAT(l_linestatus, CAST(l_orderkey AS STRING))", "string", None)),
    ("code", ("CONCAT(l_linestatus, CAST(l_orderkey AS STRING))", "string", None), ("l_linestatus", "string", None)),
    ("note", ("CAST(l_partkey AS STRING)", "string", None), ("CASE WHEN l_partkey % 2 = 0 THEN CAST(l_partkey AS STRING) END", "string", None)),
    ("memo", ("CASE WHEN l_suppkey % 2 = 0 THEN CAST(l_partkey AS STRING) END", "string", None), ("CAST(l_partkey AS STRING)", "string", None)),
    ("shipped", ("CAST(l_shipdate AS STRING)", "string", None), ("l_shipdate", "string", "date-time")),
    ("billed", ("l_shipdate", "string", "date-time"), ("CAST(l_shipdate AS STRING)", "string", None)),
    ("order_id", ("CAST(l_orderkey AS STRING)", "string", "uuid"), ("CAST(l_orderkey AS STRING)", "string", "uuid")),
    ("dropped", ("l_tax", "number", None), None),
    ("extra", None, ("CASE WHEN l_partkey % 3 = 0 THEN l_returnflag END", "string", None)),
    ("needed", None, ("l_linestatus", "string", None)),
]
SIDES = ("l_linenumber <= 3", "l_linenumber > 3")


def _version(spark, d, side: int):
    """The columns of one version of the contract's data."""
    return table(spark, d, "lineitem").where(SIDES[side]).selectExpr(*(f"{f[1 + side][0]} AS {f[0]}" for f in FIELDS if f[1 + side]))


def _clauses(spark, d, side: int):
    """The clauses that are inferred from it, a settled contract."""
    return lineage.written(infer.clause_rows(profile.profile(_version(spark, d, side), exact=False)).withColumnRenamed("column", "field"))


def _clause_sql(side: int) -> str:
    """field, type, required, minimum, maximum, format, enum of one version."""

    def one(name: str, expr: str, kind: str, fmt: str | None) -> str:
        number, confident = kind != "string", "confidence" in name and kind == "number"
        low = "0.0::DOUBLE" if confident else "CASE WHEN min(v) >= 0 THEN 0.0::DOUBLE END" if number else "NULL::DOUBLE"
        enum = "CASE WHEN count(DISTINCT v) BETWEEN 1 AND 5 THEN list_sort(list(DISTINCT v) FILTER (v IS NOT NULL)) END" if kind == "string" and not fmt else "NULL::VARCHAR[]"
        return f"SELECT '{name}' AS field, '{kind}' AS type, count(*) = count(v) AS required, {low} AS minimum, {'1.0::DOUBLE' if confident else 'NULL::DOUBLE'} AS maximum, {f"'{fmt}'" if fmt else 'NULL'}::VARCHAR AS format, {enum} AS enum FROM (SELECT {expr} AS v FROM lineitem WHERE {SIDES[side]})"

    return " UNION ALL ".join(one(f[0], *f[1 + side]) for f in FIELDS if f[1 + side])


def _changes(spark, d):
    return evolution.changes(_clauses(spark, d, 0), _clauses(spark, d, 1))


def _bound_sql(b: str) -> str:
    narrow = ">" if b == "minimum" else "<"
    return f"""
    UNION ALL SELECT field, '{b}_added', 'BREAKING' FROM j WHERE o_{b} IS NULL AND n_{b} IS NOT NULL
    UNION ALL SELECT field, '{b}_removed', 'COMPATIBLE' FROM j WHERE o_{b} IS NOT NULL AND n_{b} IS NULL
    UNION ALL SELECT field, '{b}_changed', CASE WHEN n_{b} {narrow} o_{b} THEN 'BREAKING' ELSE 'COMPATIBLE' END FROM j WHERE o_{b} <> n_{b}"""


CHANGES_SQL = f"""
    WITH o AS ({_clause_sql(0)}), n AS ({_clause_sql(1)}),
    every AS (SELECT o.field, o.type AS o_type, n.type AS n_type, o.required AS o_required, n.required AS n_required, o.minimum AS o_minimum, n.minimum AS n_minimum, o.maximum AS o_maximum, n.maximum AS n_maximum,
                  o.format AS o_format, n.format AS n_format, o.enum AS o_enum, n.enum AS n_enum,
                  coalesce(o.maximum <= 1, false) AND ((o.type = 'number' AND n.type = 'integer') OR coalesce(n.maximum > 1, false) OR coalesce(o.minimum = 0 AND n.minimum >= 10, false)) AS scale
              FROM o JOIN n USING (field)),
    j AS (SELECT * FROM every WHERE NOT scale)
    SELECT field, 'scale_mutation' AS change_type, 'CRITICAL' AS classification FROM every WHERE scale
    UNION ALL SELECT field, 'type_changed', 'BREAKING' FROM j WHERE o_type <> n_type
    UNION ALL SELECT field, 'required_changed', CASE WHEN n_required THEN 'BREAKING' ELSE 'COMPATIBLE' END FROM j WHERE o_required <> n_required
    UNION ALL SELECT field, 'enum_values_removed', 'BREAKING' FROM j WHERE len(list_filter(o_enum, lambda x: NOT list_contains(n_enum, x))) > 0
    UNION ALL SELECT field, 'enum_values_added', 'COMPATIBLE' FROM j WHERE len(list_filter(n_enum, lambda x: NOT list_contains(o_enum, x))) > 0
    UNION ALL SELECT field, 'enum_removed', 'BREAKING' FROM j WHERE o_enum IS NOT NULL AND n_enum IS NULL
    UNION ALL SELECT field, 'enum_added', 'BREAKING' FROM j WHERE o_enum IS NULL AND n_enum IS NOT NULL
    UNION ALL SELECT field, 'format_changed', CASE WHEN o_format IS NULL THEN 'BREAKING' ELSE 'COMPATIBLE' END FROM j WHERE o_format IS DISTINCT FROM n_format
    {_bound_sql("minimum")} {_bound_sql("maximum")}
    UNION ALL SELECT field, 'field_removed', 'BREAKING' FROM o WHERE field NOT IN (SELECT field FROM n)
    UNION ALL SELECT field, 'field_added', CASE WHEN required THEN 'BREAKING' ELSE 'COMPATIBLE' END FROM n WHERE field NOT IN (SELECT field FROM o)
"""


@query(CHANGES_SQL)
def schema_changes(spark, d):
    return _changes(spark, d).select("field", "change_type", "classification")


@query(f"SELECT field, change_type FROM ({CHANGES_SQL}) WHERE change_type IN ('field_added', 'field_removed')")
def field_set_diff(spark, d):
    return _changes(spark, d).where("change_type IN ('field_added', 'field_removed')").select("field", "change_type")


@query(f"""
    WITH o AS ({_clause_sql(0)}), n AS ({_clause_sql(1)}), e AS (SELECT field, o.enum AS o, n.enum AS n FROM o JOIN n USING (field) WHERE o.enum IS NOT NULL AND n.enum IS NOT NULL)
    SELECT field, 'removed' AS side, unnest(list_filter(o, lambda x: NOT list_contains(n, x))) AS value FROM e UNION ALL SELECT field, 'added', unnest(list_filter(n, lambda x: NOT list_contains(o, x))) FROM e
""")
def enum_diff(spark, d):
    rows = _changes(spark, d).where("change_type LIKE 'enum_values_%'")
    return rows.select("field", F.regexp_extract("change_type", "_([a-z]+)$", 1).alias("side"), F.explode(F.split(F.coalesce("old_value", "new_value"), ",")).alias("value"))


@query(f"WITH t AS ({_clause_sql(0)}) SELECT field AS \"column\", 'not_null' AS test FROM t WHERE required UNION ALL SELECT field, 'accepted_values' FROM t WHERE enum IS NOT NULL UNION ALL SELECT field, 'unique' FROM t WHERE format = 'uuid'")
def dbt_tests(spark, d):
    return infer.dbt_tests(_clauses(spark, d, 0).withColumnRenamed("field", "column"))


@query(f"WITH t AS ({_clause_sql(1)}) SELECT field AS \"column\", 'missing_count(' || field || ') = 0' AS \"check\" FROM t WHERE required UNION ALL SELECT field, 'duplicate_count(' || field || ') = 0' FROM t WHERE format = 'uuid' AND required")
def soda_checks(spark, d):
    return infer.soda_checks(_clauses(spark, d, 1).withColumnRenamed("field", "column"))


@query(f"""
    SELECT count(*) AS total, count(*) FILTER (classification = 'CRITICAL') AS critical, count(*) FILTER (classification = 'BREAKING') AS breaking, count(*) FILTER (classification = 'COMPATIBLE') AS compatible,
           CASE WHEN count(*) FILTER (classification = 'CRITICAL') > 0 THEN 'CRITICAL' WHEN count(*) FILTER (classification = 'BREAKING') > 0 THEN 'BREAKING' ELSE 'COMPATIBLE' END AS verdict,
           count(*) FILTER (classification <> 'COMPATIBLE') > 0 AS requires_version_bump FROM ({CHANGES_SQL})
""")
def verdict_rollup(spark, d):
    return evolution.verdict(_changes(spark, d))


def _of(spark, d, sql: str):
    """A query text over the tables that it names in braces."""
    return spark.sql(sql.replace("{array}", "array"), **{t: table(spark, d, t) for t in re.findall(r"{(\w+)}", sql) if t != "array"})


def _duck(sql: str) -> str:
    return re.sub(r"{(\w+)}", r"\1", sql.replace("{array}", "list_value"))


#: Snapshots of three contracts, one a year of shipping: SQL of both engines but for the arrays.
SNAPSHOT_SQL = """
    SELECT l_returnflag AS contract_id, year(l_shipdate) AS ts, 'quantity' AS field, 'number' AS type, TRUE AS required, min(l_quantity) AS minimum, max(l_quantity) AS maximum, CAST(NULL AS STRING) AS format, {none} AS enum FROM {lineitem} GROUP BY l_returnflag, year(l_shipdate)
    UNION ALL SELECT l_returnflag, year(l_shipdate), 'price', 'number', count(*) % 3 > 0, min(l_extendedprice), CASE WHEN count(*) % 2 = 0 THEN max(l_extendedprice) END, CASE WHEN count(*) % 5 = 0 THEN 'money' END, {none} FROM {lineitem} GROUP BY l_returnflag, year(l_shipdate)
    UNION ALL SELECT l_returnflag, year(l_shipdate), 'tax', CASE WHEN count(*) % 4 = 0 THEN 'integer' ELSE 'number' END, FALSE, 0.0, CAST(NULL AS DOUBLE), CAST(NULL AS STRING), {set} FROM {lineitem} GROUP BY l_returnflag, year(l_shipdate) HAVING count(*) % 3 <> 1
"""


@query(f"""
    WITH s AS ({_duck(SNAPSHOT_SQL.replace("{none}", "NULL::VARCHAR[]").replace("{set}", "list_sort(list(DISTINCT CAST(CAST(l_suppkey % (year(l_shipdate) % 4 + 1) AS INT) AS VARCHAR)))"))}),
    p AS (SELECT contract_id, ts AS n_ts, lag(ts) OVER (PARTITION BY contract_id ORDER BY ts) AS o_ts FROM (SELECT DISTINCT contract_id, ts FROM s) QUALIFY o_ts IS NOT NULL),
    o AS (SELECT p.contract_id, o_ts, n_ts, s.* EXCLUDE (contract_id, ts) FROM p JOIN s ON s.contract_id = p.contract_id AND s.ts = o_ts), n AS (SELECT p.contract_id, o_ts, n_ts, s.* EXCLUDE (contract_id, ts) FROM p JOIN s ON s.contract_id = p.contract_id AND s.ts = n_ts),
    j AS (SELECT contract_id, o_ts, n_ts, field, o.type AS o_type, n.type AS n_type, o.required AS o_required, n.required AS n_required, o.minimum AS o_minimum, n.minimum AS n_minimum, o.maximum AS o_maximum, n.maximum AS n_maximum, o.format AS o_format, n.format AS n_format, o.enum AS o_enum, n.enum AS n_enum FROM o JOIN n USING (contract_id, o_ts, n_ts, field)),
    c AS (
        SELECT contract_id, o_ts, n_ts, field, 'type_changed' AS change_type, 'BREAKING' AS classification FROM j WHERE o_type <> n_type
        UNION ALL SELECT contract_id, o_ts, n_ts, field, 'required_changed', CASE WHEN n_required THEN 'BREAKING' ELSE 'COMPATIBLE' END FROM j WHERE o_required <> n_required
        UNION ALL SELECT contract_id, o_ts, n_ts, field, 'enum_values_removed', 'BREAKING' FROM j WHERE len(list_filter(o_enum, lambda x: NOT list_contains(n_enum, x))) > 0
        UNION ALL SELECT contract_id, o_ts, n_ts, field, 'enum_values_added', 'COMPATIBLE' FROM j WHERE len(list_filter(n_enum, lambda x: NOT list_contains(o_enum, x))) > 0
        UNION ALL SELECT contract_id, o_ts, n_ts, field, 'format_changed', CASE WHEN o_format IS NULL THEN 'BREAKING' ELSE 'COMPATIBLE' END FROM j WHERE o_format IS DISTINCT FROM n_format
        {_bound_sql("minimum").replace("SELECT field", "SELECT contract_id, o_ts, n_ts, field")} {_bound_sql("maximum").replace("SELECT field", "SELECT contract_id, o_ts, n_ts, field")}
        UNION ALL SELECT contract_id, o_ts, n_ts, field, 'field_removed', 'BREAKING' FROM o ANTI JOIN n USING (contract_id, n_ts, field)
        UNION ALL SELECT contract_id, o_ts, n_ts, field, 'field_added', CASE WHEN required THEN 'BREAKING' ELSE 'COMPATIBLE' END FROM n ANTI JOIN o USING (contract_id, n_ts, field)
    )
    SELECT contract_id, o_ts::INT AS old_ts, n_ts::INT AS new_ts, field, change_type, classification FROM c
""")
def schema_history(spark, d):
    """All changes between consecutive snapshots of all contracts, in one plan."""
    sql = SNAPSHOT_SQL.replace("{none}", "CAST(NULL AS ARRAY<STRING>)").replace("{set}", "array_sort(collect_set(CAST(CAST(l_suppkey % (year(l_shipdate) % 4 + 1) AS INT) AS STRING)))")
    return evolution.history(_of(spark, d, sql)).select("contract_id", "old_ts", "new_ts", "field", "change_type", "classification")


#: Subscriptions by supplier, changed and failing fields by part: SQL of both engines but for the name of the array function.
SUBS_SQL = """
    SELECT CONCAT('c', CAST(s_suppkey % 4 AS STRING)) AS contract_id, s_name AS subscriber_id, CASE s_suppkey % 3 WHEN 0 THEN 'ENFORCE' WHEN 1 THEN 'WARN' ELSE 'AUDIT' END AS validation_mode, CAST(1 + s_suppkey % 3 AS INT) AS tier,
           {array}(CONCAT('f', CAST(s_suppkey % 7 AS STRING)), CONCAT('f', CAST(s_nationkey % 7 AS STRING), '.g', CAST(s_suppkey % 5 AS STRING)), CONCAT('f', CAST(s_nationkey % 5 AS STRING), '.g1.h')) AS breaking,
           {array}(CONCAT('f', CAST((s_suppkey + 1) % 7 AS STRING)), CONCAT('f', CAST(s_suppkey % 5 AS STRING), '.g2')) AS consumed
    FROM {supplier}
"""
CHANGED_SQL = "SELECT DISTINCT CONCAT('c', CAST(p_partkey % 3 AS STRING)) AS contract_id, CONCAT('f', CAST(p_size % 7 AS STRING), CASE WHEN p_partkey % 2 = 0 THEN CONCAT('.g', CAST(p_partkey % 4 AS STRING)) ELSE '' END) AS field FROM {part}"
FAILING_SQL = "SELECT DISTINCT CONCAT('c', CAST(p_partkey % 3 AS STRING)) AS contract_id, CASE p_partkey % 5 WHEN 0 THEN CONCAT('fact_f', CAST(p_size % 7 AS STRING)) WHEN 1 THEN CONCAT('node_g', CAST(p_size % 4 AS STRING)) WHEN 2 THEN 'item_' WHEN 3 THEN CONCAT('f', CAST(p_size % 7 AS STRING), '.g1') ELSE 'event_none' END AS field FROM {part}"


def _subs(spark, d):
    rows = _of(spark, d, SUBS_SQL)
    return rows.select("contract_id", "subscriber_id", "validation_mode", "tier", F.transform("breaking", lambda b: F.struct(b.alias("field"), F.concat(F.lit("breaks on "), b).alias("reason"))).alias("breaking_fields"), F.col("consumed").alias("fields_consumed"))


SUB_CTE = f"s AS ({_duck(SUBS_SQL)}), b AS (SELECT s.*, unnest(breaking) AS bf, generate_subscripts(breaking, 1) AS pos FROM s)"


@query(f"""
    WITH {SUB_CTE}, ch AS ({_duck(CHANGED_SQL)}),
    hit AS (SELECT ch.contract_id, field, subscriber_id, validation_mode, tier, arg_min(bf, pos) AS breaking_field FROM ch JOIN b USING (contract_id)
            WHERE field = bf OR starts_with(field, bf || '.') OR starts_with(bf, field || '.') GROUP BY ALL)
    SELECT contract_id, field, subscriber_id, validation_mode, tier, breaking_field, 'declared' AS risk, 'breaks on ' || breaking_field AS failure_mechanism, validation_mode = 'ENFORCE' AS will_block_pipeline FROM hit
    UNION ALL SELECT ch.contract_id, ch.field, s.subscriber_id, s.validation_mode, s.tier, NULL, 'unverified', 'Field ''' || ch.field || ''' is consumed but not declared in breaking_fields — unverified risk.', FALSE FROM ch JOIN s USING (contract_id)
    WHERE list_contains(consumed, ch.field) AND (ch.contract_id, ch.field, s.subscriber_id) NOT IN (SELECT (contract_id, field, subscriber_id) FROM hit)
""")
def consumer_impact(spark, d):
    return registry.consumer_impact(_of(spark, d, CHANGED_SQL), _subs(spark, d))


BLAST_SQL = """
    SELECT f.contract_id, f.field, subscriber_id, tier, arg_min(bf, pos) AS breaking_field FROM f JOIN b USING (contract_id)
    WHERE contains(bf, regexp_replace(f.field, '^(fact|node|edge|event|item)_', '')) OR contains(bf, f.field) GROUP BY ALL
"""


@query(f"WITH {SUB_CTE}, f AS ({_duck(FAILING_SQL)}) {BLAST_SQL}")
def blast_radius(spark, d):
    """Names found by q-grams; 'item_' leaves an empty name, which every field contains."""
    return registry.blast_radius(_of(spark, d, FAILING_SQL), _subs(spark, d))


@query("SELECT p.p_partkey, s.s_suppkey FROM part p JOIN supplier s ON contains(s_name || '.' || s_nationkey, CASE p_partkey % 3 WHEN 0 THEN p_partkey::VARCHAR WHEN 1 THEN '#' || lpad(p_partkey::VARCHAR, 9, '0') ELSE p_size || '.' END)")
def contains_pairs(spark, d):
    """Parts whose text, long or short, stands in a supplier's name: no nested loop."""
    key = F.col("p_partkey").cast("string")
    said = F.when(F.col("p_partkey") % 3 == 0, key).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("#"), F.lpad(key, 9, "0"))).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".")))
    parts = table(spark, d, "part").select("p_partkey", said.alias("needle"))
    names = table(spark, d, "supplier").select("s_suppkey", F.concat_ws(".", "s_name", F.col("s_nationkey").cast("string")).alias("name"))
    return contains_join(parts, names, "needle", "name").select("p_partkey", "s_suppkey")


EDGE_SQL = """
    SELECT 'r:' || n_regionkey AS source, 'n:' || n_nationkey AS target FROM nation
    UNION ALL SELECT 'n:' || c_nationkey, 'c:' || c_custkey FROM customer
    UNION ALL SELECT 'c:' || o_custkey, 'o:' || o_orderkey FROM orders
"""


def _edges(spark, d, cycle: bool = False):
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    out = table(spark, d, "nation").select(key("r:", "n_regionkey").alias("source"), key("n:", "n_nationkey").alias("target"))
    out = out.unionByName(table(spark, d, "customer").select(key("n:", "c_nationkey").alias("source"), key("c:", "c_custkey").alias("target")))
    out = out.unionByName(table(spark, d, "orders").select(key("c:", "o_custkey").alias("source"), key("o:", "o_orderkey").alias("target")))
    return out.unionByName(table(spark, d, "nation").select(key("n:", "n_nationkey").alias("source"), key("r:", "n_regionkey").alias("target"))) if cycle else out


@query(f"""
    WITH RECURSIVE e AS ({EDGE_SQL}), w(node_id, depth) AS (SELECT 'o:' || o_orderkey, 0 FROM orders WHERE o_orderstatus = 'P' UNION SELECT e.source, depth + 1 FROM w JOIN e ON e.target = w.node_id WHERE depth < 4)
    SELECT node_id, min(depth)::INT AS depth FROM w GROUP BY node_id
""")
def bfs_upstream(spark, d):
    seeds = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("node_id"))
    return lineage.breadth_first(seeds, _edges(spark, d), 4, reverse=True)


#: Typed edges and named nodes; what is imported isn't followed.
FLOW_SQL = """
    SELECT CONCAT('r:', CAST(n_regionkey AS STRING)) AS source, CONCAT('n:', CAST(n_nationkey AS STRING)) AS target, 'PRODUCES' AS relationship FROM {nation}
    UNION ALL SELECT CONCAT('n:', CAST(n_nationkey AS STRING)), CONCAT('r:', CAST(n_regionkey AS STRING)), 'CONSUMES' FROM {nation}
    UNION ALL SELECT CONCAT('n:', CAST(c_nationkey AS STRING)), CONCAT('c:', CAST(c_custkey AS STRING)), 'WRITES' FROM {customer}
    UNION ALL SELECT CONCAT('n:', CAST((c_nationkey + 1) % 25 AS STRING)), CONCAT('c:', CAST(c_custkey AS STRING)), 'IMPORTS' FROM {customer}
    UNION ALL SELECT CONCAT('c:', CAST(o_custkey AS STRING)), CONCAT('o:', CAST(o_orderkey AS STRING)), 'READS' FROM {orders}
"""
NODE_SQL = """
    SELECT CONCAT('r:', CAST(n_regionkey AS STRING)) AS node_id, CONCAT('region ', CAST(n_regionkey AS STRING)) AS label FROM {nation} GROUP BY n_regionkey
    UNION ALL SELECT CONCAT('n:', CAST(n_nationkey AS STRING)), n_name FROM {nation}
    UNION ALL SELECT CONCAT('c:', CAST(c_custkey AS STRING)), c_name FROM {customer}
    UNION ALL SELECT CONCAT('o:', CAST(o_orderkey AS STRING)), NULL FROM {orders}
"""
#: Contracts named like nodes, one like none, and their subscribers: named in full, in part, and not at all.
TARGET_SQL = """
    SELECT CONCAT('Nation-', CAST(n_nationkey AS STRING)) AS contract_id, CONCAT('c:', CAST(c_custkey AS STRING)) AS node_id FROM {nation} JOIN {customer} ON c_nationkey = n_nationkey
    UNION ALL SELECT CONCAT('Nation-', CAST(n_nationkey AS STRING)), CONCAT('c:', CAST(c_custkey AS STRING)) FROM {nation} JOIN {customer} ON c_nationkey = (n_nationkey + 5) % 25
    UNION ALL SELECT 'no such node', CONCAT('c:', CAST(c_custkey AS STRING)) FROM {customer}
    UNION ALL SELECT CONCAT('Nation-', CAST(n_nationkey AS STRING)), CONCAT('CUSTOMER#00000000', CAST(n_nationkey AS STRING)) FROM {nation}
    UNION ALL SELECT CONCAT('Nation-', CAST(n_nationkey AS STRING)), CONCAT('C-:', CAST(n_nationkey AS STRING)) FROM {nation}
    UNION ALL SELECT CONCAT('Nation-', CAST(n_nationkey AS STRING)), 'nobody' FROM {nation}
"""


@query(f"""
    WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT source, target FROM ({_duck(FLOW_SQL)}) WHERE relationship IN ('PRODUCES', 'WRITES', 'READS', 'CONSUMES')), n AS MATERIALIZED (SELECT node_id, replace(replace(lower(node_id), '-', ''), '_', '') AS i, replace(replace(lower(coalesce(label, '')), '-', ''), '_', '') AS l FROM ({_duck(NODE_SQL)})),
    t AS MATERIALIZED ({_duck(TARGET_SQL)}), k AS (SELECT DISTINCT contract_id, replace(replace(lower(contract_id), '-', ''), '_', '') AS stem FROM t),
    w(contract_id, node_id, depth) AS (SELECT contract_id, node_id, 0 FROM k JOIN n ON contains(i, stem) OR contains(l, stem) UNION SELECT contract_id, e.target, depth + 1 FROM w JOIN e ON e.source = w.node_id WHERE depth < 8),
    m AS MATERIALIZED (SELECT contract_id, node_id, min(depth) AS depth FROM w GROUP BY 1, 2), x AS (SELECT t.contract_id, t.node_id, m.depth FROM t LEFT JOIN m ON t.contract_id = m.contract_id AND t.node_id = m.node_id),
    part AS (SELECT x.contract_id, x.node_id, min(m.depth) AS near FROM x JOIN m ON x.contract_id = m.contract_id JOIN n ON n.node_id = m.node_id
             WHERE x.depth IS NULL AND (contains(i, replace(replace(lower(x.node_id), '-', ''), '_', '')) OR contains(l, replace(replace(lower(x.node_id), '-', ''), '_', ''))) GROUP BY 1, 2)
    SELECT x.contract_id, x.node_id, greatest(1, coalesce(x.depth, near, 1))::INT AS depth FROM x LEFT JOIN part ON x.contract_id = part.contract_id AND x.node_id = part.node_id
""")
def contamination_depth(spark, d):
    """A contract a nation, and one that names no node, searched at once."""
    return lineage.contamination(_of(spark, d, TARGET_SQL), _of(spark, d, NODE_SQL), _of(spark, d, FLOW_SQL))


#: Code files by part, each fed by two others.
FILE_SQL = "SELECT CONCAT('transformation:/repo/', lower(p_type), '/k', CAST(p_partkey AS STRING), '_load.py:', CAST(p_size AS STRING)) AS node_id, CASE p_partkey % 4 WHEN 0 THEN 'MODEL' WHEN 1 THEN 'FILE' WHEN 2 THEN 'TABLE' ELSE 'PIPELINE' END AS type, p_brand AS label FROM {part}"
LINK_SQL = """
    SELECT CONCAT('transformation:/repo/', lower(s.p_type), '/k', CAST(s.p_partkey AS STRING), '_load.py:', CAST(s.p_size AS STRING)) AS source, CONCAT('transformation:/repo/', lower(t.p_type), '/k', CAST(t.p_partkey AS STRING), '_load.py:', CAST(t.p_size AS STRING)) AS target,
           CASE s.p_partkey % 5 WHEN 0 THEN 'PRODUCES' WHEN 1 THEN 'WRITES' WHEN 2 THEN 'READS' WHEN 3 THEN 'CONSUMES' ELSE 'IMPORTS' END AS relationship
    FROM {part} AS t JOIN {part} AS s ON s.p_partkey IN (t.p_partkey + 1, t.p_partkey + 7)
"""
#: The same links by an equality: Spark joins by a list of keys in a nested loop only.
LINK_JOIN = LINK_SQL.replace("{part} AS t JOIN {part} AS s ON s.p_partkey IN (t.p_partkey + 1, t.p_partkey + 7)", "(SELECT *, explode(array(p_partkey + 1, p_partkey + 7)) AS fed_by FROM {part}) AS t JOIN {part} AS s ON s.p_partkey = t.fed_by")
PATH_SQL = "regexp_extract({c}, '^[^:]*:(/[^:]*)(?::[^:]*)?$', 1)"


@query(f"""
    WITH RECURSIVE n AS MATERIALIZED ({_duck(FILE_SQL)}), l AS MATERIALIZED ({_duck(LINK_SQL)}),
    w(node_id, depth) AS (SELECT node_id, 0 FROM n WHERE contains(lower(node_id), 'k17_load') OR contains(lower(label), 'k17_load') UNION SELECT l.source, depth + 1 FROM w JOIN l ON l.target = w.node_id WHERE depth < 4 AND relationship IN ('PRODUCES', 'WRITES', 'READS', 'CONSUMES')),
    m AS (SELECT node_id, min(depth) AS depth FROM w GROUP BY node_id),
    p AS (SELECT {PATH_SQL.format(c="node_id")} AS file_path, node_id, depth FROM m JOIN n USING (node_id) WHERE type IN ('MODEL', 'FILE', 'PIPELINE', 'SERVICE') AND {PATH_SQL.format(c="node_id")} LIKE '%.%')
    SELECT file_path, node_id, depth::INT AS depth FROM p QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY depth, node_id) = 1 ORDER BY depth, node_id LIMIT 5
""")
def producers_topk(spark, d):
    return lineage.upstream_files(_of(spark, d, FILE_SQL), _of(spark, d, LINK_JOIN), "K17_Load")


NODE_ID_SQL = "CASE page_id % 6 WHEN 0 THEN CONCAT('transformation:/abs/f', CAST(page_id AS STRING), '.py:181') WHEN 1 THEN CONCAT('file:/x.y/q', CAST(page_id AS STRING)) WHEN 2 THEN CONCAT('dataset:d', CAST(page_id AS STRING)) WHEN 3 THEN CONCAT('file:rel/', CAST(page_id AS STRING), '.sql') WHEN 4 THEN CONCAT('file:/x/y', CAST(page_id AS STRING), '.sql') ELSE CONCAT('model:/a.b/c.', CAST(page_id AS STRING), '.py:1') END"


@query(f"SELECT page_id, CASE page_id % 6 WHEN 0 THEN '/abs/f' || page_id || '.py' WHEN 4 THEN '/x/y' || page_id || '.sql' WHEN 5 THEN '/a.b/c.' || page_id || '.py' END AS path FROM pages")
def node_path(spark, d):
    return table(spark, d, "pages").select("page_id", scalar.node_path(F.expr(NODE_ID_SQL)).alias("path"))


HITS = " + ".join(f"(CASE WHEN contains(m, '{k}') THEN 1 ELSE 0 END)" for k in blame.KEYWORDS)


@query(f"""
    WITH c AS (SELECT 'c' || (event_id % 50) AS commit_hash, ts, lower(event_type || ' update schema ' || (event_id % 3)) AS m, (event_id % 3)::INT AS depth, event_id AS seq FROM events),
    r AS (SELECT commit_hash, ({HITS})::INT AS hits, round(greatest(0.0, least(1.0, 1.0 - 0.1 * datediff('day', ts::DATE, DATE '2024-01-31') - 0.2 * depth)), 3)::DOUBLE AS confidence_score, seq FROM c),
    u AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY commit_hash ORDER BY hits DESC, confidence_score DESC, seq) = 1)
    SELECT (row_number() OVER (ORDER BY hits DESC, confidence_score DESC, seq))::INT AS rank, commit_hash, hits, confidence_score FROM u ORDER BY rank LIMIT 5
""")
def blame_rank(spark, d):
    e = table(spark, d, "events")
    commits = e.select(F.format_string("c%d", F.col("event_id") % 50).alias("commit_hash"), "ts", F.format_string("%s update schema %d", "event_type", F.col("event_id") % 3).alias("message"), (F.col("event_id") % 3).cast("int").alias("depth"), F.col("event_id").alias("seq"))
    return blame.rank_commits(commits, F.lit("2024-01-31").cast("date")).select("rank", "commit_hash", "hits", "confidence_score")


@query("""
    WITH s AS (SELECT DISTINCT 'c' || (o_custkey % 97) AS contract_id, o_orderdate AS ts FROM orders), c AS (SELECT TIMESTAMP '1998-01-01' AS since),
    p AS (SELECT contract_id, max(ts) FILTER (ts <= since) AS b, max(ts) FILTER (ts > since) AS a, min(ts) AS lo, max(ts) AS hi FROM s, c GROUP BY 1),
    l AS (SELECT contract_id, max(ts) AS new_ts, list_sort(list(ts))[-2] AS old_ts FROM s GROUP BY 1)
    SELECT 'since' AS kind, contract_id, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN b ELSE lo END AS old_ts, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a ELSE hi END AS new_ts FROM p
    UNION ALL SELECT 'latest', contract_id, old_ts, new_ts FROM l
""")
def latest_snapshot(spark, d):
    s = table(spark, d, "orders").select(F.concat(F.lit("c"), (F.col("o_custkey") % 97).cast("string")).alias("contract_id"), F.col("o_orderdate").alias("ts")).distinct()
    pick = lambda df, kind: df.select(F.lit(kind).alias("kind"), "contract_id", "old_ts", "new_ts")
    return pick(evolution.snapshot_pairs(s, F.expr("TIMESTAMP '1998-01-01'")), "since").unionByName(pick(evolution.snapshot_pairs(s), "latest"))


LINE_AGREED = {"l_quantity": Clause("number", True, minimum=0.0, maximum=45.0), "l_returnflag": Clause("string", True, enum=("A", "N", "R")), "l_discount": Clause("number", True, minimum=0.0, maximum=1.0)}
ORDER_AGREED = {"o_orderstatus": Clause("string", True, enum=("F", "O")), "o_totalprice": Clause("number", True, minimum=0.0), "o_seller": Clause("string", True)}
#: Files of reports: name, contract, data path, table, rows, clauses. The last is written by no check.
FILES = [
    ("a.json", "lineitem", "data/line_1.jsonl", "lineitem", "l_linenumber = 1", LINE_AGREED),
    ("b.json", "lineitem", "data/line_2.jsonl", "lineitem", "l_linenumber = 2", LINE_AGREED),
    ("c.json", "orders", "data/orders.jsonl", "orders", "TRUE", ORDER_AGREED),
    ("d.json", "lineitem", "data/line_3_violated.jsonl", "lineitem", "l_linenumber = 3", LINE_AGREED),
    ("e.json", "archive", "violated_line_4.jsonl", "lineitem", "l_linenumber = 4", LINE_AGREED),
]


def _results(spark, d):
    """Result rows of all files, with file_name, contract_id and data_path."""
    out = None
    for name, cid, path, t, where, clauses in FILES:
        rows = checks.validate(table(spark, d, t).where(where), Contract(cid, clauses))
        rows = rows.select(F.lit(name).alias("file_name"), F.lit(cid).alias("contract_id"), F.lit(path).alias("data_path"), "column_name", "check_type", "status", "severity", "records_failing")
        out = rows if out is None else out.unionByName(rows)
    return out


def _reports(spark, d):
    return checks.counters(_results(spark, d), "file_name", "contract_id", "data_path")


def _result_sql(name, cid, path, t, where, clauses) -> str:
    def row(column: str, kind: str, level: str, bad: str) -> str:
        return f"SELECT '{name}' AS file_name, '{cid}' AS contract_id, '{path}' AS data_path, '{column}' AS column_name, '{kind}' AS check_type, CASE WHEN bad > 0 THEN '{level}' ELSE 'PASS' END AS status, '{level}' AS severity, bad AS records_failing FROM (SELECT {bad} AS bad FROM {t} WHERE {where})"

    rows = []
    for column, c in clauses.items():
        if column == "o_seller":
            rows.append(row(column, "required", "CRITICAL", "count(*)"))
            continue
        rows += [row(column, "required", "CRITICAL", f"count(*) - count({column})"), row(column, "type", "CRITICAL", "count(*) - count(*)")]
        if c.enum:
            rows.append(row(column, "enum", "CRITICAL", f"count(*) FILTER ({column} NOT IN {c.enum})"))
        if c.minimum is not None or c.maximum is not None:
            rows.append(row(column, "range", "HIGH", f"count(*) FILTER ({column} < {c.minimum})" + (f" + count(*) FILTER ({column} > {c.maximum})" if c.maximum is not None else "")))
    return " UNION ALL ".join(rows)


RESULT_SQL = " UNION ALL ".join(_result_sql(*f) for f in FILES)
REPORT_CTE = f"""res AS MATERIALIZED ({RESULT_SQL}), r AS (SELECT file_name, contract_id, data_path, count(*) AS total_checks, count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'CRITICAL') AS critical, count(*) FILTER (status = 'HIGH') AS high FROM res GROUP BY ALL)"""


@query(f"WITH {REPORT_CTE} SELECT contract_id, file_name, total_checks, passed FROM r QUALIFY row_number() OVER (PARTITION BY contract_id ORDER BY file_name DESC) = 1")
def last_report_wins(spark, d):
    return report.last_reports(_reports(spark, d)).select("contract_id", "file_name", "total_checks", "passed")


@query(f"""
    WITH {REPORT_CTE}, s AS (SELECT sum(total_checks)::BIGINT AS total, sum(passed)::BIGINT AS passed, sum(critical)::BIGINT AS critical, sum(high)::BIGINT AS high FROM r
        WHERE NOT starts_with(split_part(data_path, '/', -1), 'violated') AND NOT ends_with(data_path, '_violated.jsonl')),
    h AS (SELECT *, trunc(greatest(0, 100.0 * passed / total - 20 * critical - 10 * high - 5 * 1))::INT AS score FROM s)
    SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM h
""")
def health_score(spark, d):
    return report.health(_reports(spark, d), ai_fails=1)


@query(f"""
    WITH {REPORT_CTE} SELECT count(DISTINCT contract_id) AS contracts, sum(total_checks)::BIGINT AS total_checks, sum(passed)::BIGINT AS passed, sum(critical)::BIGINT AS critical, sum(high)::BIGINT AS high,
        (SELECT count(*) FILTER (classification <> 'COMPATIBLE') FROM ({CHANGES_SQL})) AS breaking
    FROM r WHERE NOT starts_with(split_part(data_path, '/', -1), 'violated')
""")
def summary_totals(spark, d):
    return report.totals(_reports(spark, d), _changes(spark, d))


@query("""
    WITH g AS (SELECT lang || '/' || source AS "check", count(*) FILTER (n_chars > 8000) / count(*)::DOUBLE AS rate FROM documents GROUP BY 1),
    t AS (SELECT "check", CASE WHEN rate = 0 THEN 'PASS' WHEN rate < 0.1 THEN 'WARN' ELSE 'FAIL' END AS status, rate FROM g)
    SELECT "check", status, "check" || ' ' || CASE status WHEN 'PASS' THEN 'holds' WHEN 'WARN' THEN 'needs a look' ELSE 'fails' END || printf(' (%.2f%%)', rate * 100) || '.' AS said FROM t
    UNION ALL SELECT 'empty', 'SKIP', 'empty was skipped.'
""")
def status_lines(spark, d):
    """Prompt checks of each language and source, and of none, in plain words."""
    docs = table(spark, d, "documents").select(F.concat_ws("/", "lang", "source").alias("check"), (F.col("n_chars") > 8000).cast("int").alias("bad"))
    rows = docs.groupBy("check").agg(F.avg("bad").alias("rate")).withColumn("status", F.when(F.col("rate") == 0, "PASS").when(F.col("rate") < 0.1, "WARN").otherwise("FAIL"))
    none = prompts.prompt_status(docs.where("bad > 1").select(F.array().cast("array<string>").alias("issues"))).select(F.lit("empty").alias("check"), F.lit(None).cast("double").alias("rate"), "status")
    return rows.unionByName(none).select("check", "status", prompts.status_line(F.col("check"), F.col("status"), F.col("rate")).alias("said"))


#: Subscribers of the checked tables, by supplier.
READER_SQL = """
    SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'lineitem' ELSE 'orders' END AS contract_id, s_name AS subscriber_id, CASE WHEN s_suppkey % 3 = 0 THEN 'ENFORCE' ELSE 'AUDIT' END AS validation_mode, CAST(1 + s_suppkey % 3 AS INT) AS tier,
           {array}(CASE s_nationkey % 3 WHEN 0 THEN 'l_quantity' WHEN 1 THEN 'o_orderstatus' ELSE 'l_tax' END) AS breaking, {array}('l_tax') AS consumed
    FROM {supplier}
"""


def _readers(spark, d):
    rows = _of(spark, d, READER_SQL)
    return rows.select("contract_id", "subscriber_id", "validation_mode", "tier", F.transform("breaking", lambda b: F.struct(b.alias("field"), F.lit("").alias("reason"))).alias("breaking_fields"), F.col("consumed").alias("fields_consumed"))


@query(f"""
    WITH {REPORT_CTE}, s AS ({_duck(READER_SQL)}), f AS (SELECT * FROM res WHERE status <> 'PASS' AND contract_id <> 'archive'),
    w AS (SELECT f.contract_id, column_name, list_sort(list(DISTINCT subscriber_id))[1:3] AS who FROM f JOIN s ON s.contract_id = f.contract_id AND contains(breaking[1], column_name) GROUP BY ALL)
    SELECT f.contract_id, f.column_name, format('The {{}} check of ''{{}}'' failed for {{}} records ({{}}).{{}}', check_type, f.column_name, records_failing, severity, coalesce(' It reaches ' || array_to_string(who, ', ') || ' by way of ' || array_to_string(list_transform(who, lambda x: x || '-pipeline'), ', ') || '.', ' No registered subscriber is affected.')) AS said
    FROM f LEFT JOIN w ON w.contract_id = f.contract_id AND w.column_name = f.column_name
""")
def violation_texts(spark, d):
    results = _results(spark, d).where("contract_id <> 'archive'")
    failing = results.where("status <> 'PASS'").select("contract_id", F.col("column_name").alias("field")).distinct()
    return report.violation_text(results, registry.blast_radius(failing, _readers(spark, d)))


@query(f"""
    WITH {REPORT_CTE}, s AS ({_duck(READER_SQL)}), df AS (SELECT 'lineitem' AS contract_id, CASE WHEN count(*) FILTER (classification = 'CRITICAL') > 0 THEN 'CRITICAL' ELSE 'BREAKING' END AS verdict FROM ({CHANGES_SQL}) UNION ALL SELECT 'trace', 'COMPATIBLE'),
    l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY contract_id ORDER BY file_name DESC) = 1),
    c AS (SELECT contract_id, count(*) FILTER (tier < 3) AS direct, count(*) FILTER (tier = 3) AS notified, count(*) FILTER (validation_mode = 'ENFORCE') AS enforcing FROM s GROUP BY 1)
    SELECT coalesce(l.contract_id, df.contract_id) AS contract_id, coalesce(total_checks::VARCHAR, '—') AS total_checks, coalesce(passed::VARCHAR, '—') AS passed, coalesce(critical::VARCHAR, '—') AS critical,
           coalesce(high::VARCHAR, '—') AS high, coalesce(verdict, '—') AS verdict, coalesce(direct, 0) AS direct, coalesce(notified, 0) AS notified, coalesce(enforcing, 0) AS enforcing
    FROM l FULL JOIN df ON l.contract_id = df.contract_id LEFT JOIN c ON c.contract_id = coalesce(l.contract_id, df.contract_id)
""")
def contract_table(spark, d):
    same = evolution.changes(_clauses(spark, d, 0), _clauses(spark, d, 0))  # a contract that didn't change has a verdict, too
    diffs = evolution.verdict(_changes(spark, d)).select(F.lit("lineitem").alias("contract_id"), "verdict").unionByName(evolution.verdict(same).select(F.lit("trace").alias("contract_id"), "verdict"))
    return report.contract_table(_reports(spark, d), diffs, _readers(spark, d))


@query(f"""
    WITH {REPORT_CTE}, s AS ({_duck(READER_SQL)}), b AS (SELECT string_agg(DISTINCT field, ', ' ORDER BY field) AS fields FROM ({CHANGES_SQL}) WHERE classification = 'BREAKING'),
    every AS (
        SELECT DISTINCT 1 AS priority, 'a:' || contract_id || ':' || column_name AS seq, format('''{{}}'': values of ''{{}}'' left their range; look for a change of scale.', contract_id, column_name) AS action FROM res WHERE status = 'HIGH' AND contract_id <> 'archive'
        UNION ALL SELECT DISTINCT 1, 'b:' || contract_id || ':' || column_name, format('''{{}}'': ''{{}}'' breaks the contract; repair its producer first.', contract_id, column_name) FROM res WHERE status = 'CRITICAL'
        UNION ALL SELECT 2, 'c:lineitem', format('''lineitem'': release a new version, as {{}} changed incompatibly.', fields) FROM b
        UNION ALL SELECT 3, 'd', format('Gate production on these contracts: {{}}.', string_agg(DISTINCT contract_id, ', ' ORDER BY contract_id)) FROM s WHERE validation_mode = 'ENFORCE'
        UNION ALL SELECT 3, 'e', 'Investigate text drift.' FROM ({SQL_OF_DRIFT}) WHERE status = 'WARN'
        UNION ALL SELECT 2, 'f', 'Review recent prompt changes: output violations rise.' FROM ({SQL_OF_RATE}) WHERE status = 'WARN' OR trend = 'rising'
    )
    SELECT priority, action FROM every ORDER BY priority, seq LIMIT 6
""")
def recommendations(spark, d):
    """The six most urgent actions over validated tables, a diff, subscribers, text drift and output rates."""
    results = _results(spark, d).where("contract_id <> 'archive'").select("contract_id", "column_name", "check_type", "status").distinct()
    return report.recommendations(results, _diffs(spark, d), _readers(spark, d), _ai(spark, d), 6)


def _diffs(spark, d):
    return _changes(spark, d).select(F.lit("lineitem").alias("contract_id"), "field", "change_type", "classification")


def _ai(spark, d):
    drift, rate = dense_drift(spark, d), verdict_rate(spark, d)
    return drift.select(F.lit("embedding_drift").alias("check_name"), "status", F.lit("unknown").alias("trend")).unionByName(rate.select(F.lit("output_rate").alias("check_name"), "status", "trend"))


@query(f"""
    WITH {REPORT_CTE}, w AS (SELECT DISTINCT contract_id, column_name, check_type, records_failing, status FROM res WHERE status IN ('CRITICAL', 'HIGH') AND contract_id <> 'archive'),
    k AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY status ORDER BY contract_id, column_name, check_type, records_failing) <= 2)
    SELECT CASE status WHEN 'CRITICAL' THEN 'a' ELSE 'b' END || ':' || contract_id || ':' || column_name || ':' || check_type AS seq, format('{{}}: {{}} of {{}}.{{}} fails for {{}} records', status, check_type, contract_id, column_name, records_failing) AS said FROM k
    UNION ALL SELECT 'c:lineitem', format('BREAKING: {{}} changes of lineitem', count(*)) FROM ({CHANGES_SQL}) WHERE classification = 'BREAKING'
    UNION ALL SELECT 'd', 'WARN: texts drift' FROM ({SQL_OF_DRIFT}) WHERE status = 'WARN'
    UNION ALL SELECT 'e', 'WARN: too many outputs violate their schema' FROM ({SQL_OF_RATE}) WHERE status = 'WARN'
""")
def narrated_issues(spark, d):
    """What a narrator is told of validated tables, a diff, text drift and output rates."""
    return report.issues(_results(spark, d).where("contract_id <> 'archive'"), _diffs(spark, d), _ai(spark, d))


@query("""
    SELECT * FROM (SELECT o_custkey, o_orderkey, o_orderkey - lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS step FROM orders) WHERE step <> 1
""")
def seq_gaps(spark, d):
    from pyspark.sql import Window

    step = F.col("o_orderkey") - F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", step.alias("step")).where("step <> 1")


@query("""
    SELECT user_id AS "key", 'gap' AS kind, event_id AS seq, step FROM (SELECT user_id, event_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM events) WHERE step <> 1
""")
def stream_gaps(spark, d):
    """The events as a stream: gaps in each user's numbers, found with state, equal those of the batch."""
    events = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")  # a pattern, as a stream takes no single file
    return drained(sequence_breaks(events, "user_id", "event_id", "ts"), "gaps").where("kind = 'gap'")


@query("SELECT o_custkey, o_orderkey, round(coalesce(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS starts_at FROM orders")
def running_cursor(spark, d):
    rows = etl.running_starts(table(spark, d, "orders"), "o_orderkey", "o_totalprice", "o_custkey")
    return rows.select("o_custkey", "o_orderkey", F.round("starts_at", 4).alias("starts_at"))


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z]+'))::INT AS n_tokens FROM documents")
def token_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(scalar.tokens(F.col("text"))).alias("n_tokens"))


TERM_CTE = "w AS (SELECT doc_id, {g} unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents), c AS (SELECT doc_id, {g} term, count(*) AS n FROM w GROUP BY ALL)"


@query(f"WITH {TERM_CTE.format(g='')} SELECT term, count(*) AS df FROM c GROUP BY term")
def doc_freq(spark, d):
    return text.document_frequency(text.terms(table(spark, d, "documents"), "doc_id", "text"))


@query(f"""
    WITH {TERM_CTE.format(g="")}, t AS (SELECT doc_id, sum(n) AS total FROM c GROUP BY 1), f AS (SELECT term, count(*) AS df FROM c GROUP BY 1)
    SELECT doc_id, count(*) AS terms, round(sum(n / total * (ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) + 1)), 4) AS weight FROM c JOIN t USING (doc_id) JOIN f USING (term) GROUP BY doc_id
""")
def tfidf(spark, d):
    w = text.tfidf(table(spark, d, "documents"), "doc_id", "text")
    return w.groupBy(F.col("doc").alias("doc_id")).agg(F.count("*").alias("terms"), F.round(F.sum("w"), 4).alias("weight"))


@query(f"""
    WITH {TERM_CTE.format(g="doc_id % 2 AS half,")}, t AS (SELECT doc_id, sum(n) AS total FROM c GROUP BY 1), f AS (SELECT half, term, count(*) AS df FROM c GROUP BY 1, 2), s AS (SELECT doc_id % 2 AS half, count(*) AS docs FROM documents GROUP BY 1),
    m AS (SELECT c.half, term, sum(n / total * (ln((docs + 1) / (df + 1)) + 1)) AS w FROM c JOIN t USING (doc_id) JOIN f USING (half, term) JOIN s ON s.half = c.half GROUP BY 1, 2),
    p AS (SELECT term, coalesce(max(w) FILTER (half = 0), 0) AS x, coalesce(max(w) FILTER (half = 1), 0) AS y FROM m GROUP BY term), r AS (SELECT sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))) AS sim FROM p)
    SELECT round(sim, 4) AS similarity, round(1 - sim, 4) AS drift, CASE WHEN sim >= 0.25 THEN 'PASS' ELSE 'WARN' END AS status FROM r
""")
def tfidf_drift(spark, d):
    docs = table(spark, d, "documents")
    return text.text_drift(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), "doc_id", "text")


@query(SQL_OF_DRIFT)
def dense_drift(spark, d):
    sides = text.dense_centroid(table(spark, d, "embeddings").withColumn("side", F.col("label") % 2), "embedding", "side")
    pick = lambda k: F.max(F.when(F.col("side") == k, F.col("centroid")))
    rows = sides.agg(pick(0).alias("a"), pick(1).alias("b")).select(text.cosine(F.col("a"), F.col("b")).alias("s"))
    return rows.select(F.round("s", 4).alias("similarity"), F.round(1 - F.col("s"), 4).alias("drift"), F.when(F.round(1 - F.col("s"), 4) <= text.DENSE_DRIFT, "PASS").otherwise("WARN").alias("status"))


@query("""
    WITH i AS (SELECT doc_id, 2 + (CASE WHEN length(text) > 8000 THEN 1 ELSE 0 END) AS n FROM documents)
    SELECT count(*) AS records, count(*) FILTER (n > 0) AS violations, round(count(*) FILTER (n > 0) / count(*)::DOUBLE, 4) AS rate, 'FAIL' AS status FROM i
""")
def prompt_schema(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "source", "text")
    return prompts.prompt_status(prompts.with_issues(docs, "doc_id", "source", "text"))


@query("SELECT doc_id, '''content_preview'' too long (len=' || length(text) || ', max=8000)' AS _quarantine_reason FROM documents WHERE length(text) > 8000")
def quarantine(spark, d):
    docs = table(spark, d, "documents").withColumn("uid", scalar.uuid5(F.col("doc_id").cast("string")))
    return prompts.quarantine(prompts.with_issues(docs, "uid", "source", "text")).select("doc_id", "_quarantine_reason")


@query(SQL_OF_RATE)
def verdict_rate(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return prompts.output_rate(rows.select(prompts.verdict_of_score((F.col("quality") * 3).cast("string")).alias("overall_verdict")), baseline=0.1)


@query("SELECT o_orderkey, substr(sha256(o_orderkey::VARCHAR || '|' || o_orderstatus || '|' || o_orderpriority), 1, 16) AS sha FROM orders")
def sha256_fingerprint(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.substring(F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority"), 256), 1, 16).alias("sha"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS iso FROM events")
def iso_normalise(spark, d):
    return table(spark, d, "events").select("event_id", scalar.iso_from_postgres(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("+00"))).alias("iso"))


VERSION_SQL = "CASE p_partkey % 6 WHEN 0 THEN CONCAT(CAST(p_size AS STRING), '.0') WHEN 1 THEN CAST(p_size AS STRING) WHEN 2 THEN CONCAT('1.', CAST(p_size AS STRING), '.3') WHEN 3 THEN CONCAT('1.2.', CAST(p_size AS STRING), '.4') WHEN 4 THEN '' END"


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_size || '.0.0' WHEN 1 THEN p_size || '.0.0' WHEN 2 THEN '1.' || p_size || '.3' WHEN 3 THEN '1.2.' || p_size ELSE '1.0.0' END AS padded FROM part")
def semver_pad(spark, d):
    return table(spark, d, "part").select("p_partkey", scalar.semver(F.expr(VERSION_SQL)).alias("padded"))


@query("""
    SELECT p_partkey, CASE WHEN p_size > 1 THEN g::BIGINT END AS page_ref, round(greatest(0.0, least(1.0, p_retailprice / 1500)), 6)::DOUBLE AS confidence FROM part, LATERAL (SELECT unnest(generate_series(1, greatest(p_size, 1))) AS g)
""")
def row_generation(spark, d):
    rows = etl.fact_rows(table(spark, d, "part"), F.col("p_partkey"), F.col("p_size"), F.col("p_retailprice") / 1500, "p_partkey")
    return rows.select("p_partkey", "page_ref", F.round("confidence", 6).alias("confidence"))


@query("""
    WITH p AS (SELECT doc_id, greatest(10, n_chars // 4)::BIGINT AS p FROM documents), c AS (SELECT *, greatest(5, p // 5)::BIGINT AS c FROM p)
    SELECT doc_id, p AS prompt_tokens, c AS completion_tokens, p + c AS total_tokens, round(p / 1000.0::DOUBLE * 0.003 + c / 1000.0::DOUBLE * 0.015, 6) AS total_cost FROM c
""")
def token_cost(spark, d):
    return table(spark, d, "documents").select("doc_id", *(c.alias(n) for n, c in etl.usage(F.col("n_chars")).items()))


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'HIGH' WHEN '2-HIGH' THEN 'HIGH' ELSE 'LOW' END AS level FROM orders")
def map_lookup(spark, d):
    return table(spark, d, "orders").select("o_orderkey", scalar.lookup({"1-URGENT": "HIGH", "2-HIGH": "HIGH"}, F.col("o_orderpriority"), "LOW").alias("level"))


@query("""
    WITH m AS (SELECT string_split(min(p), '/') AS a, string_split(max(p), '/') AS b FROM (SELECT '/repo/src/' || p_type || '/' || p_name || '.py' AS p FROM part)),
    k AS (SELECT a, (SELECT min(i) FROM (SELECT unnest(range(1, len(a) + 1)) AS i) WHERE a[i] IS DISTINCT FROM b[i]) AS k FROM m)
    SELECT array_to_string(a[1:k - 1], '/') AS codebase_root FROM k
""")
def path_prefix(spark, d):
    return etl.codebase_root(table(spark, d, "part").select(F.concat(F.lit("/repo/src/"), "p_type", F.lit("/"), "p_name", F.lit(".py")).alias("path")), "path")


@query("""
    SELECT l_orderkey, l_linenumber, round(round(l_discount * 100, 4), 4) AS confidence FROM lineitem
""")
def inject_scale(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array(F.struct(F.col("l_discount").alias("confidence"))).alias("facts"))
    return etl.inject_scale(rows, "facts", "confidence").select("l_orderkey", "l_linenumber", F.col("facts")[0]["confidence"].alias("confidence"))


@query("""
    WITH f AS (SELECT max(event_id) AS last FROM (SELECT event_id FROM events ORDER BY event_id LIMIT 50))
    SELECT event_id, CASE WHEN event_id <= last THEN 'InvalidEventXYZ' ELSE event_type END AS event_type, CASE WHEN event_id <= last THEN event_type END AS _original_event_type FROM events, f
""")
def inject_enum(spark, d):
    return etl.inject_enum(table(spark, d, "events"), "event_type", "event_id", "InvalidEventXYZ").select("event_id", "event_type", "_original_event_type")


@query("SELECT run_id, kind, count(*) AS runs, min(start_s)::BIGINT AS first_s, max(end_s)::BIGINT AS last_s FROM (SELECT 'n' || n_nationkey AS run_id, unnest(['root', 'dimension', 'tool', 'llm']) AS kind, unnest([1, 10, 23, 30]) AS k, unnest([0, 2, 22, 45]) AS start_s, unnest([2, 22, 45, 135]) AS end_s FROM nation), LATERAL (SELECT unnest(generate_series(1, k))) GROUP BY 1, 2")
def trace_synthesis(spark, d):
    runs = etl.trace_runs(table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("run_id")))
    checked = etl.must_hold(runs, ends_after_start=F.col("end_s") > F.col("start_s"))
    return checked.groupBy("run_id", "kind").agg(F.count("*").alias("runs"), F.min("start_s").cast("long").alias("first_s"), F.max("end_s").cast("long").alias("last_s"))


@query("SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS total, count(*) FILTER (event_type = 'error') AS bad, round(count(*) FILTER (event_type = 'error') / count(*)::DOUBLE, 6) AS rate FROM events GROUP BY 1")
def windowed_violations(spark, d):
    out = windowed_rate(table(spark, d, "events"), "ts", F.col("event_type") == "error")
    return rounded(out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")), "rate")


@query("WITH b AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS r, count(*) OVER () AS n FROM events) SELECT event_id, CASE WHEN r <= n // 2 THEN 'baseline' ELSE 'current' END AS half FROM b")
def position_halves(spark, d):
    """The first and the second half by position in the table, from row counts per partition, not a global window."""
    return text.halves(table(spark, d, "events")).select("event_id", F.when(F.col("second"), "current").otherwise("baseline").alias("half"))


@query("""
    SELECT event_id AS run_id, CASE WHEN user_id % 7 = 1 THEN NULL WHEN user_id % 7 >= 3 THEN 'PASS' ELSE 'FAIL' END AS overall_verdict
    FROM events WHERE event_type = 'click' AND user_id % 7 > 0
""")
def trace_verdicts(spark, d):
    """Model runs with a score; of seven users one has none and one's is no number."""
    user = F.col("user_id") % 7
    outputs = F.when(user == 0, "{}").when(user == 1, '{"score": "none"}').otherwise(F.format_string('{"score": %d}', user))
    runs = table(spark, d, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "click", "llm").otherwise("tool").alias("run_type"), outputs.alias("outputs"))
    return prompts.trace_verdicts(runs)


@query("""
    SELECT n.n_regionkey AS run_id, n.n_nationkey AS dimension_id, c.final_score, coalesce(c.remediation, '') AS remediation
    FROM nation n LEFT JOIN (SELECT s_nationkey, count(*) AS final_score, min(s_name) AS remediation FROM supplier GROUP BY 1) c ON c.s_nationkey = n.n_nationkey
""")
def rubric_criteria(spark, d):
    nation = table(spark, d, "nation").select(F.col("n_regionkey").alias("run_id"), F.col("n_nationkey").alias("dimension_id"))
    scores = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("dimension_id")).agg(F.count("*").alias("final_score"), F.min("s_name").alias("remediation"))
    return etl.with_criteria(nation, scores.join(nation, "dimension_id"))


@query("SELECT count(DISTINCT o_orderpriority) FILTER (o_orderpriority <> upper(o_orderpriority)) AS changed, count(DISTINCT o_custkey) FILTER (o_custkey % 3 > 0) AS moved FROM orders")
def remapped_keys(spark, d):
    moved = F.col("o_custkey") + F.col("o_custkey") % 3
    return table(spark, d, "orders").agg(etl.remapped(F.col("o_orderpriority"), F.upper("o_orderpriority")).alias("changed"), etl.remapped(F.col("o_custkey"), moved).alias("moved"))
