"""Rules of single operators on literal rows."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pactlake.contract import Clause, Contract, inferred_dtype
from pactlake.functions import scalar
from pactlake.operators import blame, checks, drift, etl, evolution, flatten, infer, lineage, profile, prompts, registry, report, text
from pactlake.operators.substrings import contains_join
from pactlake.sources import readers, sinks
from pactlake.streaming.validation import validate_stream


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_dtypes_depend_on_nulls():
    from pyspark.sql import types as T

    assert inferred_dtype(T.LongType(), False) == "int64" and inferred_dtype(T.LongType(), True) == "float64"
    assert inferred_dtype(T.BooleanType(), True) == "object" and inferred_dtype(T.StringType(), False) == "object"
    assert inferred_dtype(T.DecimalType(20, 0), False) == "object"


def test_uuid5_equals_python(spark):
    import uuid

    names = ["", "a", "doc:17", "é日本", "x" * 500]
    got = dict(rows(spark.createDataFrame([(n,) for n in names], "n string").select("n", scalar.uuid5(F.col("n")))))
    assert got == {n: str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names}


def test_iso_agrees_with_python(spark):
    texts = ["2024-02-29", "2023-02-29", "2024-01-01T23:59:59.123+05:30", "2024-01-01T23:59:60", "2024-13-01", "20240229T1010", "2024-W05", "2024-W60", "", "2024-01-01T10:00Z"]
    texts += ["2023-W53-1", "2020-W53-7", "2026-W53", "2024-W01-1T25:00", "2024-W01-1T23:00", "2024W011T10", "2024-W00-1", "2024-W01-8", "0000-01-01", "x"]
    texts += ["2024-01-01T10:00+25:00", "2024-01-01T10:00+23:59", "2024-01-01T10:00-00:60", "2024-01-01T10:00+05:30:15", "20240101T1010+2400"]

    def ok(t):
        try:
            datetime.fromisoformat(t)
            return True
        except ValueError:
            return False

    got = dict(rows(spark.createDataFrame([(t,) for t in texts], "t string").select("t", scalar.is_iso_datetime(F.col("t")))))
    assert got == {t: ok(t) for t in texts}


def test_only_declared_enforcing_consumers_block(spark):
    from pactlake.operators import registry

    subs = spark.createDataFrame(
        [("c", "s1", "ENFORCE", 1, "x@y", [("a.b", "sums it")], ["a.b", "z"]), ("c", "s2", "ENFORCE", 2, None, [("q", None)], ["z"]), ("c", "s3", "AUDIT", 3, "m", [("z", "shows it")], [])],
        "contract_id string, subscriber_id string, validation_mode string, tier int, contact string, breaking_fields array<struct<field string, reason string>>, fields_consumed array<string>",
    )
    got = registry.consumer_impact(spark.createDataFrame([("c", "a"), ("c", "z")], "contract_id string, field string"), subs)
    unverified = "Field 'z' is consumed but not declared in breaking_fields — unverified risk."
    assert sorted((r.field, r.subscriber_id, r.tier, r.contact, r.failure_mechanism, r.will_block_pipeline) for r in got.collect()) == [
        ("a", "s1", 1, "x@y", "sums it", True),
        ("z", "s1", 1, "x@y", unverified, False),
        ("z", "s2", 2, None, unverified, False),
        ("z", "s3", 3, "m", "shows it", False),
    ]


def test_only_required_ids_are_checked_for_duplicates(spark):
    from pactlake.operators import infer

    clauses = spark.createDataFrame([("a", True, "uuid"), ("b", False, "uuid"), ("c", True, None)], "column string, required boolean, format string")
    assert sorted(r.check for r in infer.soda_checks(clauses).collect()) == ["duplicate_count(a) = 0", "missing_count(a) = 0", "missing_count(c) = 0"]


def test_flatten_keeps_empty_arrays_and_prefixes(spark):
    df = spark.createDataFrame([("d1", "p", [{"text": "a", "k": 1}, {"text": "b", "k": None}], "m"), ("d2", "q", [], None)], "doc_id string, fact_text string, extracted_facts array<struct<text string, k int>>, _meta string")
    out = flatten.flatten(df)
    assert out.columns == ["doc_id", "fact_text", "fact_k"]
    assert sorted(rows(out), key=str) == [("d1", "a", 1), ("d1", "b", None), ("d2", None, None)]
    assert flatten.explode_key(df) == "extracted_facts" and flatten.prefix_of("things") == "thing_"
    assert rows(flatten.flatten(spark.createDataFrame([(1, [5, 6])], "id int, values array<int>"), "values")) == [(1, 5), (1, 6)]


def test_profile_of_nan_nulls_and_one_value(spark):
    df = spark.createDataFrame([(1.0, 3), (float("nan"), None), (None, None)], "x double, y int")
    got = {r.column: r for r in profile.profile(df).collect()}
    assert got["x"].null_fraction == pytest.approx(2 / 3) and got["x"].mean == 1.0 and got["x"].stddev == 0.0 and got["x"].cardinality == 1
    assert got["y"].sample_values == ["3"]
    cheap = {r.column: r for r in profile.profile(spark.range(5000).selectExpr("id", "id % 2 AS half"), exact=False).collect()}
    assert cheap["half"].sample_values == ["0", "1"] and len(cheap["id"].sample_values) == 2 and abs(cheap["id"].cardinality - 5000) < 250
    empty = profile.numeric(df.limit(0)).collect()
    assert [r.mean for r in empty] == [None, None]


def test_inference_rules(spark):
    data = [(f"u{i}", 0.9 if i % 2 else None, i % 3, "ab"[i % 2], "2024-01-01", -1.0) for i in range(30)]
    df = spark.createDataFrame(data, "doc_id string, fact_confidence double, n long, kind string, seen_at string, cost double")
    c = infer.infer(df, "t").schema
    assert c["doc_id"].format == "uuid" and c["doc_id"].required
    assert (c["fact_confidence"].minimum, c["fact_confidence"].maximum, c["fact_confidence"].required) == (0.0, 1.0, False)
    assert c["n"].type == "integer" and c["n"].minimum == 0.0 and c["n"].maximum is None
    assert c["kind"].enum == ("a", "b") and c["seen_at"].format == "date-time" and c["seen_at"].enum is None
    assert {w["code"] for w in c["cost"].distribution_warnings} >= {"unexpected_negatives"}
    strict = infer.clause_rows(profile.profile(df.select(F.col("n").alias("n_id"))), uuid_strings_only=True).collect()
    assert strict[0].format is None
    assert rows(infer.mixed_types(spark.createDataFrame([("1",), ("x",)], "c string"), ["c"])) == [("c", 1, 2)]


def status_of(df, contract, **kw):
    return {r.check_id: (r.status, r.records_failing) for r in checks.validate(df, contract, **kw).collect()}


def test_injected_scale_trips_exactly_range_and_drift(spark):
    base = spark.createDataFrame([(f"d{i}", [{"confidence": 0.5 + i / 100}]) for i in range(40)], "doc_id string, extracted_facts array<struct<confidence double>>")
    clean = flatten.flatten(base)
    contract = Contract("t", {"doc_id": Clause("string", True), "fact_confidence": Clause("number", True, 0.0, 1.0)})
    baselines = {r.column: r.asDict() for r in profile.numeric(clean).collect()}
    before = status_of(clean, contract, baselines=baselines)
    after = status_of(flatten.flatten(etl.inject_scale(base, "extracted_facts", "confidence")), contract, baselines=baselines)
    assert {s for s, _ in before.values()} == {"PASS"}
    assert {k for k in after if after[k] != before[k]} == {"t.fact_confidence.range", "t.fact_confidence.statistical_drift"}
    assert after["t.fact_confidence.range"] == ("HIGH", 40) and after["t.fact_confidence.statistical_drift"][0] == "HIGH"


def test_injected_enum_trips_the_enum(spark):
    base = spark.createDataFrame([(i, "a") for i in range(60)], "id long, kind string")
    contract = Contract("t", {"kind": Clause("string", True, enum=("a", "b"))})
    assert {s for s, _ in status_of(base, contract).values()} == {"PASS"}
    after = status_of(etl.inject_enum(base, "kind", "id", "Bad"), contract)
    assert after["t.kind.enum_conformance"] == ("CRITICAL", 50) and after["t.kind.type_match"][0] == "PASS"


def test_wide_contracts_are_batched(spark):
    df = spark.range(3).select(*(F.col("id").alias(f"c{i}") for i in range(90)))
    contract = Contract("w", {f"c{i}": Clause("integer", True) for i in range(90)})
    out = checks.validate(df, contract)
    assert out.count() == 180 and out.select("check_order").distinct().count() == 180


def test_drift_edges(spark):
    one = spark.createDataFrame([(1.0,)], "x double")
    assert status_of(one, Contract("t"), baselines={}) == {}
    base = spark.createDataFrame([("x", 1.0, 0.0)], "column string, mean double, stddev double")
    now = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "column string, mean double")
    got = {r.column: r for r in drift.drift(now, base).collect()}
    assert got["x"].status == "PASS" and got["x"].z_score == 0 and got["y"].first_run


def test_gate(spark):
    df = spark.createDataFrame([(m, c, h, e) for m in ("AUDIT", "WARN", "ENFORCE") for c, h, e in ((0, 1, 0), (1, 0, 0), (0, 0, 1))], "m string, c int, h int, e int")
    got = [tuple(r) for r in df.select("m", checks.blocks(F.col("m"), F.col("c"), F.col("h")), checks.blocks(F.col("m"), F.col("c"), F.col("h"), F.col("e"), True)).collect()]
    assert got == [("AUDIT", False, False)] * 3 + [("WARN", False, False), ("WARN", True, True), ("WARN", False, True)] + [("ENFORCE", True, True), ("ENFORCE", True, True), ("ENFORCE", False, True)]


def clauses(spark, data):
    return spark.createDataFrame(data, "field string, type string, required boolean, minimum double, maximum double, format string, enum array<string>")


def test_same_schema_has_no_changes_and_required_flips(spark):
    a = clauses(spark, [("x", "string", True, None, None, None, ["a"]), ("y", "number", False, 0.0, 1.0, None, None)])
    b = clauses(spark, [("x", "string", False, None, None, None, ["a"]), ("y", "number", True, 0.0, 1.0, None, None)])
    assert rows(evolution.changes(a, a)) == []
    there = {r.field: r.classification for r in evolution.changes(a, b).collect()}
    back = {r.field: r.classification for r in evolution.changes(b, a).collect()}
    assert there == {"x": "COMPATIBLE", "y": "BREAKING"} and back == {"x": "BREAKING", "y": "COMPATIBLE"}
    assert evolution.rollback(evolution.changes(a, b)).count() == 1 and evolution.checklist(evolution.changes(a, b)).count() == 1


def test_since():
    now = datetime(2024, 1, 15)
    assert evolution.parse_since("3 days ago", now) == datetime(2024, 1, 12) and evolution.parse_since("nonsense", now) == datetime(2024, 1, 8)


def test_search_ends_on_cycles_and_respects_depth(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "source string, target string")
    seeds = spark.createDataFrame([("a",)], "node_id string")
    assert dict(rows(lineage.breadth_first(seeds, edges))) == {"a": 0, "b": 1, "c": 2, "d": 3, "e": 4}
    assert dict(rows(lineage.breadth_first(seeds, edges, 2))) == {"a": 0, "b": 1, "c": 2}
    assert dict(rows(lineage.breadth_first(seeds, edges, 1, reverse=True))) == {"a": 0, "c": 1}


def test_blame(spark):
    commits = spark.createDataFrame([("h1", "fix schema", "2024-01-01", 0, 0), ("h2", "docs", None, 1, 1), ("h1", "fix schema", "2024-01-01", 3, 2)], "commit_hash string, message string, ts string, depth int, seq int")
    got = rows(blame.rank_commits(commits.withColumn("ts", F.col("ts").cast("date")), F.lit("2024-01-03").cast("date")).select("rank", "commit_hash", "hits", "confidence_score"))
    assert got == [(1, "h1", 2, 0.8), (2, "h2", 0, 0.0)]
    ranked = blame.rank_commits(commits.withColumn("ts", F.col("ts").cast("date")), F.lit("2024-01-03").cast("date"))
    assert "tier 3" in blame.blame_chain(ranked, 3, True).first().note and "not at hand" in blame.blame_chain(ranked, 1, False).first().note


def test_registry_normalisation(spark, tmp_path):
    (tmp_path / "r.yaml").write_text("subscriptions:\n- {contract_id: c, subscriber_id: s, breaking_fields: [a, {field: b, reason: why}], fields_consumed: [z], tier: 1}\n")
    df = readers.registry(spark, str(tmp_path / "r.yaml"))
    assert df.first().breaking_fields[0].field == "a" and df.first().breaking_fields[1].reason == "why"
    assert readers.registry(spark, str(tmp_path / "none.yaml")).count() == 0
    assert rows(registry.blast_radius(spark.createDataFrame([("c", "item_b")], "contract_id string, field string"), df).select("subscriber_id", "breaking_field")) == [("s", "b")]


def test_text_drift_of_same_and_empty_sides(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "b c d")], "id int, t string")
    same = text.text_drift(docs, docs, "id", "t").first()
    assert (same.similarity, same.status) == (1.0, "PASS")
    assert text.text_drift(docs, docs.limit(0), "id", "t").first().status == "SKIP"
    vectors = text.embed(docs, "t", lambda ts: [[float(len(t)), 1.0] for t in ts])
    assert rows(text.dense_centroid(vectors, "embedding"))[0][0] == [5.0, 1.0]
    assert text.hashed_sample(docs, "id", 1).count() == 1


def test_prompts(spark):
    df = spark.createDataFrame([("0" * 8 + "-0000-0000-0000-" + "0" * 12, "p", "ok"), ("x", "", None), (None, "p", "y" * 8001)], "doc_id string, source_path string, content_preview string")
    checked = prompts.with_issues(df, "doc_id", "source_path", "content_preview")
    assert [len(r.issues) for r in checked.collect()] == [0, 4, 2]
    assert prompts.prompt_status(checked).first().status == "FAIL" and prompts.quarantine(checked).count() == 2
    v = spark.createDataFrame([("PASS",), (None,), ("odd",)], "overall_verdict string")
    assert prompts.output_rate(v).first().violations == 2 and prompts.output_rate(v, baseline=0.1).first().trend == "rising"


def test_migrations(spark):
    led = spark.createDataFrame([("a", "layout", 1.7, 0, 1.5, 0), ("b", "odd", None, 3, None, 1)], "doc_id string, strategy_used string, confidence double, block_count int, processing_time double, index int")
    out = {r.source_path: r for r in etl.extractions(led, {"layout": "m1"}, {"layout": 10}).collect()}
    assert len(out["a"].extracted_facts) == 1 and out["a"].extracted_facts[0].page_ref is None and out["a"].extracted_facts[0].confidence == 1.0
    assert len(out["b"].extracted_facts) == 3 and out["b"].extracted_facts[2].page_ref == 3 and out["b"].extracted_facts[0].confidence == 0.9
    assert out["a"].processing_time_ms == 1500 and out["a"].token_count.output == 2 and out["b"].extraction_model == "unknown"
    n = etl.nodes(spark.createDataFrame([("transformation:/a/b.py:1", None), ("odd:x", "L")], "id string, label string")).collect()
    assert [(r.type, r.label) for r in n] == [("MODEL", "b.py"), ("EXTERNAL", "L")]
    assert etl.edges(spark.createDataFrame([("a", "b", "reads"), ("a", "b", "odd")], "source string, target string, type string")).select("relationship").collect()[1][0] == "PRODUCES"
    e = etl.events(spark.createDataFrame([("e1", "loan-1", "1.0", "2024-01-01 10:00:00+00")], "event_id string, aggregate_id string, schema_version string, occurred_at string")).first()
    assert e.schema_version == "1.0.0" and e.occurred_at == "2024-01-01T10:00:00+00:00" and len(e.aggregate_id) == 36
    with pytest.raises(Exception, match="positive"):
        etl.must_hold(spark.createDataFrame([(0,)], "x int"), positive=F.col("x") > 0).collect()


def test_files(spark, tmp_path):
    contract = Contract("c-1", {"a_id": Clause("string", True, format="uuid"), "k": Clause("string", enum=("x",))})
    assert readers.contract(sinks.contract_yaml(contract, str(tmp_path))).schema == contract.schema
    assert "accepted_values" in open(sinks.dbt_schema(contract, str(tmp_path))).read()
    sinks.schema_snapshot(contract, str(tmp_path), datetime(2024, 1, 1))
    assert readers.snapshot(readers.snapshot_paths(str(tmp_path), "c-1")[0])["schema"]["k"]["enum"] == ["x"]
    path = str(tmp_path / "b.json")
    sinks.merge_baselines(path, {"x": {"mean": 1}})
    assert sinks.merge_baselines(path, {"x": {"mean": 2}, "y": {"mean": 3}}) == {"x": {"mean": 1}, "y": {"mean": 3}}
    (tmp_path / "d.jsonl").write_text('{"a": 1, "p": {"q": 1}}\n\n{"a": 2, "p": "s"}\n')
    assert readers.jsonl(spark, str(tmp_path / "d.jsonl")).count() == 2
    v = readers.jsonl_variant(spark, str(tmp_path / "d.jsonl"))
    assert sorted(rows(v.select(flatten.scalar_or_null(F.expr("variant_get(v, '$.p', 'variant')")))), key=str) == [("s",), (None,)]
    results = checks.validate(spark.createDataFrame([("x",)], "k string"), contract)
    assert sinks.report(results, {"report_id": "r"}, str(tmp_path / "r.json"))["critical"] == 1
    back = readers.json_documents(spark, str(tmp_path), pattern="r.json").first()
    assert back.file_name == "r.json" and back.total_checks == 3
    assert readers.commits(spark, ["x"], str(tmp_path)).count() == 0 and readers.commits(spark, [], str(tmp_path)).count() == 0 and readers.json_or(str(tmp_path / "no"), []) == []
    assert checks.load_failure(spark, "c", "boom").first().status == "ERROR"
    sinks.append_log(results, str(tmp_path / "log"))
    sinks.append_log(results, str(tmp_path / "log"))
    assert readers.jsonl(spark, str(tmp_path / "log")).count() == 6


def test_report_rows(spark):
    r = spark.createDataFrame([(s,) for s in (95, 85, 75, 65, 5)], "s int").select(report.grade(F.col("s")))
    assert [x[0] for x in r.collect()] == ["A", "B", "C", "D", "F"]
    empty = spark.createDataFrame([], "data_path string, total_checks int, passed int, critical int, high int")
    assert report.health(empty).first().score == 100


def test_stream_is_validated(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, None)], "id long, k string").write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema("id long, k string").parquet(str(tmp_path / "in"))
    q = validate_stream(stream, Contract("s", {"k": Clause("string", True)}), lambda df, i: seen.extend(r.status for r in df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert "CRITICAL" in seen


def test_quantiles_and_halves(spark):
    import numpy as np
    from pactlake.operators import profile, text

    values = np.concatenate([np.full(500, 3.0), np.random.default_rng(1).normal(size=501)])
    df = spark.createDataFrame([(float(v), i, None) for i, v in enumerate(values)] + [(float("nan"), None, None)], "x double, i long, none double").repartition(5)
    got = {r["column"]: r for r in profile.quantiles(df, ["x", "i", "none"]).collect()}
    assert set(got) == {"x", "i"}
    for c, held in (("x", values), ("i", np.arange(len(values)))):
        assert np.allclose([got[c][p] for p in profile.QUANTILES], np.percentile(held, [100 * q for q in profile.QUANTILES.values()]))
    assert profile.quantiles(df.limit(0), ["x"]).count() == 0 and profile.numeric(df.limit(0), ["x"]).first().p50 is None
    for n in (0, 1, 7, 100):
        parts = text.halves(spark.range(0, n, 1, 3)).collect()
        assert [r.second for r in sorted(parts)] == [i >= n // 2 for i in range(n)]


def test_severities_are_the_levels_of_checks(spark):
    """A passing row has its check's level, drift that of its status; drift counts no failing records."""
    rows = spark.createDataFrame([(i, float(i), "a") for i in range(10)], "id long, x double, kind string")
    agreed = Contract("t", {"id": Clause("integer", True), "x": Clause("number", True, minimum=0.0, maximum=5.0), "kind": Clause("string", True, enum=("a",)), "gone": Clause("string", True)})
    got = {r.check_id.split("t.", 1)[1]: (r.check_type, r.status, r.severity, r.records_failing) for r in checks.validate(rows, agreed, {"x": {"mean": 0.0, "stddev": 0.1}}).collect()}
    assert got["id.required.no_nulls"] == ("required", "PASS", "CRITICAL", 0) and got["id.type_match"] == ("type", "PASS", "CRITICAL", 0)
    assert got["kind.enum_conformance"] == ("enum", "PASS", "CRITICAL", 0) and got["x.range"] == ("range", "HIGH", "HIGH", 4)
    assert got["gone.required.present"] == ("required", "CRITICAL", "CRITICAL", 10)
    assert got["x.statistical_drift"] == ("statistical_drift", "HIGH", "HIGH", 0) and got["id.statistical_drift"] == ("statistical_drift", "PASS", "HIGH", 0)


def test_wide_contracts_drift_in_batches(spark):
    """Each batch has the drift of its own columns; columns that no clause names come last; each check is there once."""
    rows = spark.createDataFrame([tuple(float(i + c) for c in range(9)) for i in range(5)], ", ".join(f"c{c} double" for c in range(9)))
    agreed = Contract("t", {f"c{c}": Clause("number", True) for c in range(5)})
    one, many = (sorted((r.check_id, r.status) for r in checks.validate(rows, agreed, {}, batch=b).collect()) for b in (40, 2))
    assert one == many and len({c for c, _ in one}) == len(one) == 19


@pytest.mark.parametrize("most", [10**6, 2])
def test_lists_of_agreed_values(spark, monkeypatch, most):
    """A list in a table, broadcast or not, with nulls and repeats, beside samples of what fails."""
    monkeypatch.setattr(checks, "LISTED_ROWS", most)
    rows = spark.createDataFrame([("a",), ("b",), (None,), ("z",), ("z",), ("y",)], "k string")
    listed = spark.createDataFrame([("a",), ("b",), ("b",), (None,), ("c",)], "value string")
    r = checks.validate(rows, Contract("t", {"k": Clause(type="")}), lists={"k": listed}, samples=5).first()
    assert (r.status, r.records_failing, r.sample_failing) == ("CRITICAL", 3, ["y", "z"])
    assert checks.validate(rows.limit(0), Contract("t", {"k": Clause(type="")}), lists={"k": listed}).first().status == "PASS"


def test_bad_lines_are_kept_and_counted(spark, tmp_path):
    path = tmp_path / "d.jsonl"
    path.write_text('{"id": 1, "k": "a"}\n\n{"id": 2, "k"\n{"id": 3, "k": "b"}\nnonsense\n')
    agreed = Contract("t", {"id": Clause("integer", True), "k": Clause("string", True, enum=("a", "b"))})
    for rows in (readers.jsonl_kept(spark, str(path)), readers.jsonl_kept(spark, str(path), "id long, k string"), readers.parsed(spark.read.text(str(path)), "id long, k string")):
        got = {r.check_id: (r.status, r.severity, r.records_failing) for r in checks.validate(rows, agreed, corrupt=readers.CORRUPT).collect()}
        assert got["t.__file__.load"] == ("ERROR", "CRITICAL", 2) and got["t.id.required.no_nulls"][0] == got["t.k.enum_conformance"][0] == "PASS"
    kept = readers.parsed(spark.read.text(str(path)), "id long, k string").where(f"{readers.CORRUPT} IS NOT NULL")
    assert sorted(r[0] for r in kept.select(readers.CORRUPT).collect()) == ["nonsense", '{"id": 2, "k"']


def test_contains_join_equals_the_nested_loop(spark):
    needles = [("", 1), ("a", 1), ("ab", 1), ("abc", 2), ("bcda", 1), (None, 1), ("zzz", 1), ("é🙂", 2), ("abcabcabc", 1), ("abc", 2)]
    texts = [("abcd", 1), ("bcdabc", 1), ("", 1), (None, 2), ("xé🙂y", 2), ("abcabcabcabc", 1), ("a", 2), ("abc", 2)]
    n, t = spark.createDataFrame(needles, "needle string, k int"), spark.createDataFrame(texts, "text string, k int")
    want = sorted((a, x, i) for a, i in needles for x, j in texts if i == j and a is not None and x is not None and a in x)
    assert sorted((r.needle, r.text, r.k) for r in contains_join(n, t, "needle", "text", ("k",)).collect()) == want
    every = sorted((a, x) for a, _ in needles for x, _ in texts if a is not None and x is not None and a in x)
    assert sorted((r.needle, r.text) for r in contains_join(n.drop("k"), t.drop("k"), "needle", "text").collect()) == every
    assert contains_join(n.limit(0), t, "needle", "text", ("k",)).count() == 0 == contains_join(n, t.limit(0), "needle", "text", ("k",)).count()


def test_contamination_follows_the_flow_of_each_contract(spark):
    """Imports aren't followed; a subscriber named in part has the least depth of what is named so; else depth is 1."""
    nodes = spark.createDataFrame([("svc:week3-docs", None), ("m:a", "model a"), ("m:b", "sink_one"), ("m:c", None), ("x", None)], "node_id string, label string")
    edges = spark.createDataFrame([("svc:week3-docs", "m:b", "IMPORTS"), ("svc:week3-docs", "m:a", "PRODUCES"), ("m:a", "m:b", "WRITES"), ("m:b", "m:c", "READS"), ("m:c", "svc:week3-docs", "CONSUMES"), ("x", "m:c", "PRODUCES")], "source string, target string, relationship string")
    asked = [("week3_docs", s) for s in ("m:b", "sink-one", "m:c", "nobody", "svc:week3-docs")] + [("X", "m:c"), ("X", "sink-one"), ("none", "m:b")]
    got = {(r.contract_id, r.node_id): r.depth for r in lineage.contamination(spark.createDataFrame(asked, "contract_id string, node_id string"), nodes, edges).collect()}
    assert got == {("week3_docs", "m:b"): 2, ("week3_docs", "sink-one"): 2, ("week3_docs", "m:c"): 3, ("week3_docs", "nobody"): 1, ("week3_docs", "svc:week3-docs"): 1, ("X", "m:c"): 1, ("X", "sink-one"): 4, ("none", "m:b"): 1}


def test_mixed_records_become_one_frame(spark):
    docs = [{"id": 1, "name": "a", "items": [{"k": 1, "t": "x"}, 5, "text", None, [1], {"k": "two", "in": {"a": 1}}]}, {"id": 2, "items": []}, {"id": "three", "extra": 1.5}, {"id": 4, "items": {"not": "an array"}}]
    v = spark.createDataFrame([(json.dumps(x),) for x in docs], "j string").select(F.parse_json("j").alias("v"))
    rows = flatten.flatten_variant(v, "v")
    assert set(rows.columns) == {"id", "name", "extra", "item_k", "item_t", "item_value"}
    got = [(r.id, r.item_k, r.item_t, r.item_value) for r in rows.collect()]
    assert sorted(got, key=str) == sorted([("1", "1", "x", None), ("1", None, None, "5"), ("1", None, None, "text"), ("1", None, None, None), ("1", None, None, None), ("1", "two", None, None), ("2", None, None, None), ("three", None, None, None), ("4", None, None, None)], key=str)
    assert flatten.flatten_variant(v.limit(0), "v").count() == 0
    plain = flatten.flatten_variant(spark.createDataFrame([('{"a": 1, "b": [1]}',)], "j string").select(F.parse_json("j").alias("v")), "v")
    assert plain.columns == ["a"] and plain.first().a == 1


@pytest.mark.parametrize("values", [[1.0], [0.0, -0.0, 5e-324, -5e-324], [1e300, -1e300, 1e-300, 3.0], [7.0] * 50 + [8.0], [float(2**53 + i) for i in range(0, 40, 2)], [1 + i * 2**-52 for i in range(30)], [float("inf"), 1.0, float("-inf")]])
def test_quantiles_tell_any_doubles_apart(spark, values):
    import numpy as np

    rows = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
    got = profile.quantiles(rows, ["x"]).first()
    for name, q in profile.QUANTILES.items():
        at = q * (len(values) - 1)
        low, high = sorted(values)[int(np.floor(at))], sorted(values)[int(np.ceil(at))]
        want = low if at == np.floor(at) else (np.floor(at) + 1 - at) * low + (at - np.floor(at)) * high
        assert got[name] == want or (got[name] != got[name] and want != want)


def test_without_records_the_checks_of_inputs_and_outputs_are_skipped(spark):
    none = spark.createDataFrame([], "doc_id string, source_path string, p string, overall_verdict string")
    assert prompts.prompt_status(prompts.with_issues(none, "doc_id", "source_path", "p")).first().status == "SKIP"
    r = prompts.output_rate(none, baseline=0.1).first()
    assert (r.status, r.trend, r.outputs) == ("SKIP", "unknown", 0)


def test_sequences_are_followed_across_batches(spark, tmp_path):
    """State outlives a micro-batch; late numbers are out of order, idle keys are closed; files come one by one."""
    from pactlake.streaming.sequences import drained, sequence_breaks

    files = [
        [("a", 1, "2024-01-01 00:00:00"), ("a", 2, "2024-01-01 00:00:10"), ("b", 5, "2024-01-01 00:00:00"), (None, 1, "2024-01-01 00:00:00")],
        [("a", 5, "2024-01-01 00:01:00"), ("a", 3, "2024-01-01 00:01:00"), ("a", 2, "2024-01-01 00:01:00"), ("a", 6, "2024-01-01 00:01:30")],
        [("a", 7, "2024-01-01 09:00:00"), ("a", 7, "2024-01-01 09:00:00")],
        [("a", 9, "2024-01-01 09:30:00")],
    ]
    for i, rows in enumerate(files):
        part = tmp_path / "in" / f"{i}.json"
        part.parent.mkdir(exist_ok=True)
        part.write_text("".join(json.dumps(dict(zip(("k", "n", "at"), r))) + "\n" for r in rows))
        import os

        os.utime(part, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema("k string, n long, at timestamp").option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")
    got = sorted((r.key, r.kind, r.seq, r.step) for r in drained(sequence_breaks(stream, "k", "n", "at"), "breaks").collect())
    assert [r for r in got if r[1] == "gap"] == [("a", "gap", 5, 2), ("a", "gap", 7, 0), ("a", "gap", 9, 2)]
    assert [r for r in got if r[1] == "order"] == [("a", "order", 2, 0)]
    assert ("b", "closed", 5, 1) in got


def test_lines_are_numbered_as_files_are_read(spark, tmp_path):
    import os

    want = []
    for name, n in (("b.txt", 3000), ("a.txt", 1), ("c.txt", 700), ("empty.txt", 0)):
        lines = ["" if i % 7 == 3 else f"{name} {i}" for i in range(n)]
        (tmp_path / name).write_text("".join(x + "\n" for x in lines))
        want += [(name, i + 1, x) for i, x in enumerate(lines)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = readers.numbered_lines(spark, f"file://{tmp_path}")
        assert got.rdd.getNumPartitions() > 1 and sorted((os.path.basename(r.file_path), r.line, r.value) for r in got.collect()) == sorted(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_states_merge_and_columns_without_values_count_nothing(spark):
    from pactlake.operators import sketches

    rows = spark.createDataFrame([(float(i), i % 5, None) for i in range(1000)] + [(float("nan"), None, None)], "x double, k int, none double")
    parts = [sketches.state(rows.where(w), "c") for w in ("x < 300", "x >= 300 AND NOT isnan(x)", "isnan(x)", "false")]
    got = {r["column"]: r for r in sketches.profile_of(sketches.merged(*parts)).collect()}
    assert (got["x"].n, got["x"].mean, got["x"].min, got["x"].max) == (1000, pytest.approx(499.5), 0.0, 999.0) and got["x"].stddev == pytest.approx(288.8194, abs=1e-3)
    assert abs(got["x"].p50 - 499.5) < 15 and abs(got["x"].cardinality - 1000) < 30 and got["k"].cardinality == 5
    assert got["none"].n == 0 and got["none"].mean is None and got["none"].p50 is None and got["none"].cardinality == 0 and got["none"].null_fraction == 1.0


def test_first_values_of_mixed_columns(spark):
    rows = spark.createDataFrame([(str(i), "-1.5", "x") for i in range(20)] + [("late", "1", "y")], "a string, b string, c string").coalesce(1)
    odd = spark.createDataFrame([("1",), ("two",), ("3.",), ("-.5",), (None,)], "d string")
    assert infer.mixed_types(rows, ["a", "b", "c"]).collect() == []  # the odd value is the twenty-first
    r = infer.mixed_types(odd, ["d"]).first()
    assert (r["column"], r.numeric, r.seen) == ("d", 3, 4) and infer.mixed_types(odd, []).collect() == []


def test_contract_header(spark, tmp_path):
    import hashlib

    data = b"x" * 70_000 + b"y"
    (tmp_path / "d.jsonl").write_bytes(data)
    sha = readers.head_hash(spark, f"file://{tmp_path}/d.jsonl")
    assert sha == hashlib.sha256(data[:65_536]).hexdigest() and readers.head_hash(spark, f"file://{tmp_path}/none") is None
    assert readers.file_fingerprint(spark, f"file://{tmp_path}/d.jsonl").first().sha == sha
    c = infer.with_header(Contract("t"), "d.jsonl", sha)
    assert c.servers["local"] == {"type": "local", "path": "d.jsonl", "format": "jsonl"} and sha in c.info["description"] and c.terms["usage"]


def test_snapshots_by_the_time_that_they_tell(tmp_path):
    import argparse

    from pactlake.cli import _pair

    for name, at in (("1.yaml", "2024-03-01T00:00:00"), ("2.yaml", "2024-01-01T00:00:00+00:00"), ("3.yaml", "2024-02-01T00:00:00")):
        (tmp_path / "c").mkdir(exist_ok=True)
        (tmp_path / "c" / name).write_text(f"captured_at: '{at}'\nschema: {{}}\n")
    for v in ("v1", "v2"):
        (tmp_path / v).mkdir()
        (tmp_path / v / "old.json").write_text("{}")
    pair = lambda cid, since=None: [p.rsplit("/", 1)[1] for p in _pair(argparse.Namespace(snapshots=str(tmp_path), since=since), cid)]
    assert pair("c") == ["3.yaml", "1.yaml"] and readers.snapshot_contracts(str(tmp_path)) == ["c", "old"] and pair("old") == ["old.json", "old.json"]


def test_missing_lineage_has_no_nodes(spark, tmp_path):
    nodes, edges = readers.latest_lineage(spark, f"file://{tmp_path}/none.jsonl")
    assert nodes.count() == edges.count() == 0
    asked = spark.createDataFrame([("c", "s")], "contract_id string, node_id string")
    assert [tuple(r) for r in lineage.contamination(asked, nodes, edges).collect()] == [("c", "s", 1)]
    assert lineage.upstream_files(nodes, edges, "c").count() == 0
    (tmp_path / "g.jsonl").write_text('{"captured_at": "2024-01-01", "nodes": [{"node_id": "a", "type": "FILE", "label": "x"}], "edges": []}\n')
    assert readers.latest_lineage(spark, f"file://{tmp_path}/g.jsonl", f"captured_at string, nodes array<struct<node_id: string, type: string, label: string>>, edges array<struct<source: string, target: string, relationship: string>>")[0].first().node_id == "a"


def test_hash_of_the_first_records(spark, tmp_path):
    import hashlib
    import json

    records = [{"b": i, "a": "\u00e9"} for i in range(12)]
    want = hashlib.sha256(json.dumps(records[:10], sort_keys=True).encode()).hexdigest()[:16]
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a.jsonl").write_text("\n\n".join(json.dumps(r, ensure_ascii=False) for r in records[:7]), encoding="utf-8")
    (tmp_path / "one" / "b.jsonl").write_text("\n".join(map(json.dumps, records[7:])) + "\nnot JSON")
    assert readers.records_hash(spark, f"file://{tmp_path}/one") == want
    assert readers.records_hash(spark, f"file://{tmp_path}/none") is None and readers.records_hash(spark, f"file://{tmp_path}/one", 20) is None


def test_embedding_drift(spark):
    a, b = (spark.createDataFrame(rows, "t string") for rows in ([("aa",), ("b",)], [("cccc",)]))
    vectors = lambda texts: [[float(len(t)), 1.0] for t in texts]
    kept = []
    got = text.embedding_drift(a, b, "t", vectors, lambda c: kept.append(c.first().centroid)).first()
    assert kept == [[1.5, 1.0]] and (got.similarity, got.status) == (round(7 / (3.25**0.5 * 17**0.5), 4), "PASS")
    assert text.embedding_drift(a, b.limit(0), "t", vectors) is None

    def failing(texts):
        raise RuntimeError

    assert text.embedding_drift(a, b, "t", failing) is None


def test_copies_of_a_needle_are_dealt_over_tasks(spark):
    needles = spark.range(5000).select(F.col("id").alias("n"), F.lit("7.").alias("needle")).unionByName(spark.createDataFrame([(-1, "text number 1"), (-2, "number 1x")], "n long, needle string"))
    texts = spark.range(40).select(F.col("id").alias("t"), F.concat(F.lit("text number "), F.col("id").cast("string"), F.lit(".")).alias("text"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = contains_join(needles, texts, "needle", "text").select("n", "t", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    want = [(n, t) for n in range(5000) for t in (7, 17, 27, 37)] + [(-1, t) for t in (1, *range(10, 20))]
    assert sorted((r.n, r.t) for r in got) == sorted(want)
    assert len({r.task for r in got if r.n >= 0}) > 1


def test_rates_are_printed_as_c_prints_them(spark):
    import random

    draw = random.Random(3)
    said = [0.0, -0.0, 0.125, 0.375, 0.625, 0.005, 0.015, 1.005, 2.675, 12.345, 33.335, 99.995, 99.999, 100.0, 1e-300, 0.004999999999999999, -1.125, -0.001, 123456789.125]
    said += [draw.randrange(0, 80001) / 800 for _ in range(300)] + [100 * (a / b) for b in range(1, 400, 7) for a in range(0, b, 3)]
    got = dict(rows(spark.createDataFrame(list(enumerate(said)), "k int, x double").select("k", scalar.two_digits(F.col("x")))))
    assert got == {k: "%.2f" % x for k, x in enumerate(said)}
    line = spark.createDataFrame([("a", "WARN", 0.00125), ("b", "SKIP", None)], "c string, s string, r double").select(prompts.status_line(F.col("c"), F.col("s"), F.col("r")))
    assert [r[0] for r in line.collect()] == ["a needs a look (0.12%).", "b was skipped."]


def test_fact_rows_equal_facts_and_make_what_is_read(spark):
    df = spark.createDataFrame([(1, 3, 0.5), (2, None, None), (3, 0, 7.0), (4, -2, -1.0), (None, 2, 0.25)], "k long, n int, c double")
    args = F.col("k"), F.col("n"), F.col("c")
    every = etl.fact_rows(df, *args, "k")
    assert sorted(map(str, every.collect())) == sorted(map(str, df.select("k", F.inline(etl.facts(*args))).collect()))
    plan = every.select("k", "page_ref")._jdf.queryExecution().executedPlan().toString()
    assert "sha1" not in plan and "format_string" not in plan


def _tfidf_of(docs):
    import math
    import re
    from collections import Counter

    found: dict = {}
    for doc, said in docs:
        found.setdefault(doc, []).extend(re.findall("[a-z]+", (said or "").lower()))
    df = Counter(t for f in found.values() for t in set(f))
    return {(d, t): n / len(f) * (math.log((len(docs) + 1) / (df[t] + 1)) + 1) for d, f in found.items() for t, n in Counter(f).items()}


def test_tfidf_equals_brute_force_and_moves_texts_once(spark):
    import re

    for docs in ([(1, "a b a c"), (2, "A, b!"), (3, None), (4, ""), (5, "b zz 7")], [(1, "a b a c"), (1, "c d"), (2, "a")]):
        df = text.tfidf(spark.createDataFrame(docs, "i long, t string"), "i", "t")
        got, want = df.collect(), _tfidf_of(docs)
        assert len(got) == len(want) and {(r.doc, r.term): pytest.approx(r.w) for r in got} == want
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(doc#\w+, term#", plan)


def test_tasks_count_terms_of_bounded_shares(spark, monkeypatch):
    monkeypatch.setattr(text, "TASK_CHARS", 100)
    docs = spark.createDataFrame([(i, "ab cd " * 10) for i in range(50)], "i long, t string").coalesce(1)
    assert text.by_document(docs, "i", "t").rdd.getNumPartitions() == 31
    assert rows(text.document_frequency(text.terms(docs, "i", "t")).orderBy("term")) == [("ab", 50), ("cd", 50)]
    got = {k: pytest.approx(w) for k, w in rows(text.term_weights(docs, "i", "t", F.lit(50)))}
    assert got == {"ab": 25.0, "cd": 25.0}


def test_ends_that_no_target_is_are_left_out_of_the_search(spark, monkeypatch):
    nodes = spark.createDataFrame([("src", None), ("mid", None), ("end-one", None), ("end-two", "far sink")], "node_id string, label string")
    edges = spark.createDataFrame([(a, b, "READS") for a, b in (("src", "mid"), ("mid", "end-one"), ("src", "end-two"), ("mid", "lost-end"))], "source string, target string, relationship string")
    asked = spark.createDataFrame([("src", s) for s in ("mid", "end_one", "far sink", "lost", "nobody")], "contract_id string, node_id string")
    held, search = [], lineage.breadth_first
    monkeypatch.setattr(lineage, "breadth_first", lambda seeds, edges, *a, **k: held.append(edges) or search(seeds, edges, *a, **k))
    got = {r.node_id: r.depth for r in lineage.contamination(asked, nodes, edges).collect()}
    assert got == {"mid": 1, "end_one": 2, "far sink": 1, "lost": 2, "nobody": 1}
    assert [r.target for r in held[0].select("target").collect()] == ["mid"]
