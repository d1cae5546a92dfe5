"""Command line: infer, validate, diff, history, attribute, ai and report, each over files, in a chain.

python -m pactlake.cli infer --data d.jsonl --id orders --out contracts
python -m pactlake.cli validate --contract contracts/orders.yaml --data d.jsonl --mode ENFORCE --out reports/orders.json
"""

from __future__ import annotations

import argparse
import functools
import glob
import importlib
import json
import os
import sys
from datetime import datetime, timezone

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactlake.contract import Contract
from pactlake.operators import blame, checks, evolution, flatten, hooks, infer, lineage, profile, prompts, registry, report, text
from pactlake.sources import readers, sinks
from pactlake.sources.gitlog import PUSHDOWN


#: Fewer clauses than this make a contract suspicious.
FEW_CLAUSES = 6


def session() -> SparkSession:
    return SparkSession.builder.appName("pactlake").config(PUSHDOWN, "true").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def load(spark: SparkSession, path: str) -> DataFrame:
    """A flat frame of a JSON Lines or Parquet dataset."""
    raw = spark.read.parquet(path) if ".parquet" in path else readers.jsonl(spark, path)
    return flatten.drop_empty_columns(flatten.flatten(raw))


def load_kept(spark: SparkSession, path: str, keep: bool) -> tuple[DataFrame, str | None]:
    """A flat frame, with the column of unreadable lines if these are kept."""
    raw = spark.read.parquet(path) if ".parquet" in path else readers.jsonl_kept(spark, path) if keep else readers.jsonl(spark, path)
    corrupt = readers.CORRUPT if readers.CORRUPT in raw.columns else None
    return flatten.flatten(raw, keep=(corrupt,) if corrupt else ()), corrupt


def _dump(doc, path: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(doc, f, indent=2, default=str)


def cmd_infer(a) -> int:
    spark = session()
    rows = load(spark, a.data)
    contract = infer.infer(rows, a.id, exact=not a.approximate)
    if a.registry:
        subs = readers.registry(spark, a.registry).where(F.col("contract_id") == a.id)
        down = [{"id": r.subscriber_id, "fields_consumed": list(r.fields_consumed or [])} for r in subs.collect()]
        contract = Contract(**{**contract.__dict__, "lineage": {"downstream": down}})
    for r in infer.mixed_types(rows, [f.name for f in rows.schema.fields if f.dataType.typeName() == "string"]).collect():
        print(f"{r['column']}: {r.numeric} of the first {r.seen} values look like numbers, the others don't", file=sys.stderr)
    contract = infer.with_header(contract, a.data, readers.head_hash(spark, a.data) if ".parquet" in a.data else readers.records_hash(spark, a.data))
    contract = hooks.annotate(contract, None)
    if len(contract.schema) < FEW_CLAUSES:
        print(f"only {len(contract.schema)} clauses were inferred", file=sys.stderr)
    print(sinks.contract_yaml(contract, a.out), sinks.dbt_schema(contract, a.out))
    if a.table:
        sinks.snapshot_table(_clause_frame(spark, {a.id: contract.as_dict()}), datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%fZ"), a.table)
    if a.snapshots:
        sinks.schema_snapshot(contract, a.snapshots)
        stats = {f"{a.id}.{r.column}": r.asDict() for r in profile.numeric(rows).collect()}
        sinks.merge_baselines(os.path.join(a.snapshots, "baselines.json"), stats)
    return 0


def cmd_validate(a) -> int:
    spark = session()
    contract = readers.contract(a.contract)
    header = {"report_id": a.report_id or datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%SZ"), "contract_id": contract.id, "data_path": a.data, "enforcement_mode": a.mode}
    stored = readers.json_or(a.baselines, {}) if a.baselines else {}
    prefix = f"{contract.id}."
    base = {k.removeprefix(prefix): v for k, v in stored.items() if k.startswith(prefix)}
    try:  # what can't be read fails here, an error in a check below
        rows, corrupt = load_kept(spark, a.data, a.keep_bad_lines)
        seen = profile.moments(rows)
    except PySparkException as e:
        doc = sinks.report(checks.load_failure(spark, contract.id, str(e)), header, a.out)
    else:
        rows = rows.select(*(F.col(f"`{c}`") for c, m in seen.items() if m["count"] or c == corrupt))
        doc = sinks.report(checks.validate(rows, contract, base, samples=a.samples, corrupt=corrupt), header, a.out)
        if corrupt and a.quarantine:
            rows.where(F.col(corrupt).isNotNull()).select(F.col(corrupt).alias("line")).write.mode("append").json(a.quarantine)
        if a.baselines:
            sinks.merge_baselines(a.baselines, {prefix + c: {k: m[k] for k in ("mean", "stddev")} for c, m in seen.items() if "mean" in m and m["count"] > 1})
    stop = {"AUDIT": False, "WARN": doc["critical"] > 0, "ENFORCE": doc["critical"] + doc["high"] > 0}[a.mode] or (a.fail_on_error and doc["errored"] > 0)
    print({k: doc[k] for k in ("total_checks", "passed", "warned", "high", "critical", "errored")}, "blocked" if stop else "passes")
    return int(stop)


CLAUSE_FRAME = "contract_id string, field string, type string, required boolean, minimum double, maximum double, format string, enum array<string>"


def _clause_frame(spark: SparkSession, snapshots: dict[str, dict]) -> DataFrame:
    """Clause rows of snapshots by contract."""
    bound = lambda c, b: float(c[b]) if c.get(b) is not None else None
    rows = [(cid, f, c.get("type"), bool(c.get("required")), bound(c, "minimum"), bound(c, "maximum"), c.get("format"), [str(v) for v in c["enum"]] if c.get("enum") is not None else None) for cid, doc in snapshots.items() for f, c in (doc.get("schema") or {}).items()]
    return spark.createDataFrame(rows, CLAUSE_FRAME)


def cmd_diff(a) -> int:
    """One contract, or every contract that has two snapshots, each into its own file of the folder --out; all are compared in one job."""
    spark = session()
    if a.old:
        pairs = {a.id or "": (a.old, a.new)}
    else:
        pairs = {cid: _pair(a, cid) for cid in ([a.id] if a.id else readers.snapshot_contracts(a.snapshots))}
    if a.id and pairs[a.id] is None:
        sys.exit(f"{a.id} has fewer than two snapshots")
    pairs = {cid: p for cid, p in pairs.items() if p}
    old, new = (_clause_frame(spark, {cid: readers.snapshot(p[side]) for cid, p in pairs.items()}) for side in (0, 1))
    rows = evolution.changes(old, new, ("contract_id",)).cache()
    by = lambda df, *order: functools.reduce(lambda out, r: out.setdefault(r["contract_id"], []).append(r.asDict()) or out, df.orderBy("contract_id", *order).collect(), {})
    found, verdicts = by(rows, "field", "change_type"), by(evolution.verdict(rows, "contract_id"))
    steps, back = ({cid: [r["step"] for r in found_rows] for cid, found_rows in by(f(rows), "field", "step").items()} for f in (evolution.checklist, evolution.rollback))
    impact = by(registry.consumer_impact(rows.select("contract_id", "field").distinct(), readers.registry(spark, a.registry)), "field", "subscriber_id") if a.registry else {}
    none = {"total": 0, "critical": 0, "breaking": 0, "compatible": 0, "verdict": "COMPATIBLE", "requires_version_bump": False}
    for cid, (was, now) in pairs.items():
        summary = {k: v for k, v in verdicts.get(cid, [none])[0].items() if k != "contract_id"}
        own = [{k: v for k, v in r.items() if k != "contract_id"} for r in found.get(cid, [])]
        doc = {"contract_id": cid or None, "old": was, "new": now, "changes": own, "summary": summary, "migration_checklist": steps.get(cid, []), "rollback_plan": back.get(cid, [])}
        _dump(doc | ({"consumer_impact": impact.get(cid, [])} if a.registry else {}), os.path.join(a.out, f"schema_evolution_{cid}.json") if a.id is None and not a.old else a.out)
        print(cid, summary)
    return 0


def cmd_history(a) -> int:
    """The changes between consecutive versions of every contract of a snapshot table, and the verdict of each step, in jobs that don't depend on how many there are."""
    spark = session()
    found = evolution.history(spark.read.schema(f"ts string, {CLAUSE_FRAME}").parquet(a.table))
    sinks.records(found, os.path.join(a.out, "changes"))
    sinks.records(evolution.verdict(found, "contract_id", "old_ts", "new_ts"), os.path.join(a.out, "verdicts"))
    return 0


def _pair(a, cid: str) -> tuple[str, str] | None:
    """The two snapshots to compare, by the times that they tell; None if there are fewer."""
    paths = readers.snapshot_paths(a.snapshots, cid)
    if len(paths) < 2:
        return None
    times = {p: readers.snapshot_time(p) for p in paths}
    paths.sort(key=lambda p: (times[p], p))
    if not a.since:
        return paths[-2], paths[-1]
    cut = evolution.parse_since(a.since, datetime.now(timezone.utc))
    before, after = [p for p in paths if times[p] <= cut], [p for p in paths if times[p] > cut]
    return (before[-1], after[-1]) if before and after else (paths[0], paths[-1])


def _commits(spark: SparkSession, files: list[tuple[str, int]], root: str) -> DataFrame:
    """Commits of a few files (path, depth), newest first within each."""
    depths = F.array(*(F.lit(depth) for _, depth in files)).cast("array<int>")
    found = readers.commits(spark, [path for path, _ in files], root)
    found = found.withColumns({"seq": F.col("place") * 1_000_000 + F.col("seq"), "depth": F.get(depths, F.col("place"))})
    return blame.rank_commits(found, F.current_date()).cache()  # five at most; git is asked once


def cmd_attribute(a) -> int:
    """Failing checks -> log entries with blame chain and blast radius."""
    spark = session()
    doc = readers.json_or(a.report, {})
    failing = [r for r in doc.get("results", []) if str(r.get("status", "")).upper() != "PASS"]
    if not failing:
        print("nothing to attribute")
        return 0
    columns = ["check_id", "column_name", "check_type", "status", "severity", "actual_value", "expected", "message", "records_failing"]
    ddl = "check_order int, contract_id string, " + ", ".join(f"{c} {'long' if c == 'records_failing' else 'string'}" for c in columns)
    rows = spark.createDataFrame([(i, doc["contract_id"], *(r.get(c) for c in columns)) for i, r in enumerate(failing)], ddl)
    subs = readers.registry(spark, a.registry).withColumn("place", F.monotonically_increasing_id())
    hit = registry.blast_radius(rows.select("contract_id", F.col("column_name").alias("field")).distinct(), subs)
    depths, labels, files = spark.createDataFrame([], "node_id string, depth int"), spark.createDataFrame([], "node_id string, label string"), []
    if a.lineage:
        nodes, edges = readers.latest_lineage(spark, a.lineage)
        stem = os.path.splitext(os.path.basename(doc.get("data_path", "")))[0]
        labels = nodes.select("node_id", "label")
        depths = lineage.contamination(hit.select("contract_id", F.col("subscriber_id").alias("node_id")).distinct(), nodes, edges).drop("contract_id")
        files = [(r.file_path, r.depth) for r in lineage.upstream_files(nodes, edges, stem).collect()]  # five at most
    ranked, spare = _commits(spark, files if a.root else [], a.root), None
    if a.root and not ranked.limit(1).count():
        spare = _commits(spark, [(p, 1) for p in sorted(glob.glob(os.path.join(a.root, a.scripts)))[:3]], a.root)
    chain, far = (blame.blame_chain(ranked, tier, bool(a.root), spare) for tier in (None, 3))
    sinks.append_log(blame.violations(rows, hit, subs, depths, labels, chain, far, doc.get("data_path", "")), a.log)
    print(len(failing), "failing checks attributed")
    return 0


def _callable(name: str | None):
    """What 'module:function' names; None without a name."""
    if not name:
        return None
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def cmd_ai(a) -> int:
    spark = session()
    raw = readers.jsonl(spark, a.data)
    out: dict = {}
    if a.mode in ("all", "drift"):
        rows = text.halves(raw)
        sides = [rows.where("NOT second").drop("second"), rows.where("second").drop("second")]
        texts = [text.hashed_sample(flatten.texts(s, a.array) if a.array else s.select(F.col(a.text).alias("text")), "text") for s in sides]
        keep = (lambda c: sinks.centroid_cache(c, a.centroid)) if a.centroid else None
        drift = text.embedding_drift(*texts, "text", _callable(a.provider), keep) if a.provider else None
        if drift is None:
            drift = text.text_drift(*(t.withColumn("id", F.monotonically_increasing_id()) for t in texts), "id", "text")
        out["embedding_drift"] = drift.first().asDict()
    if a.mode in ("all", "prompt"):
        checked = prompts.with_issues(raw, "doc_id", "source_path", a.preview)
        out["prompt_schema"] = prompts.prompt_status(checked).first().asDict()
        if a.quarantine:
            sinks.quarantine(checked, a.quarantine)
    if a.mode in ("all", "output_rate") and (a.verdicts or a.traces):
        verdicts = readers.jsonl(spark, a.verdicts) if a.verdicts else None
        if a.traces and (verdicts is None or not verdicts.limit(1).count()):  # verdicts are made from traces where there are none
            runs = readers.jsonl(spark, a.traces, "id string, run_type string, outputs string")
            verdicts = prompts.trace_verdicts(runs)
        out["output_rate"] = prompts.output_rate(verdicts).first().asDict()
    if a.log and out:
        outcomes = spark.createDataFrame([(k, v["status"], v.get("rate")) for k, v in out.items()], "check_name string, status string, rate double")
        sinks.ai_breaches(outcomes, a.log)
    _dump(out, a.out)
    print(out)
    return 0


def cmd_report(a) -> int:
    """Health, totals, contracts, violations in plain words and recommendations of a folder of reports (and of diffs)."""
    spark = session()
    result = "array<struct<check_id: string, column_name: string, check_type: string, status: string, severity: string, actual_value: string, expected: string, records_failing: bigint>>"
    ddl = f"contract_id string, data_path string, total_checks int, passed int, critical int, high int, results {result}"
    reports = readers.json_documents(spark, a.reports, ddl).where("total_checks IS NOT NULL").cache()
    change = "array<struct<field: string, change_type: string, classification: string>>"
    told = readers.json_documents(spark, a.diffs, f"contract_id string, changes {change}, summary struct<verdict: string>") if a.diffs else spark.createDataFrame([], f"contract_id string, changes {change}, summary struct<verdict: string>")
    told = told.where("contract_id IS NOT NULL").cache()
    changes = told.select("contract_id", F.inline("changes"))
    subs = readers.registry(spark, a.registry or "")
    ai = readers.json_or(a.ai, {}) if a.ai else {}
    outcomes = spark.createDataFrame([(k, v.get("status"), v.get("trend")) for k, v in ai.items()], "check_name string, status string, trend string")
    row = report.health(reports, sum(v.get("status") == "FAIL" for v in ai.values())).first().asDict()
    narrator = _callable(a.narrator)
    row["narrative"] = hooks.narrate(row["score"], row["grade"], row, narrator)
    row["totals"] = report.totals(reports, changes).first().asDict()
    last = report.last_reports(reports)
    row["contracts"] = [r.asDict() for r in last.drop("results").collect()]
    row["contract_table"] = [r.asDict() for r in report.contract_table(reports, told.select("contract_id", "summary.verdict"), subs).orderBy("contract_id").collect()]
    failing = reports.select("contract_id", F.inline("results")).where("status <> 'PASS'")
    hit = registry.blast_radius(failing.select("contract_id", F.col("column_name").alias("field")).distinct(), subs)
    row["violations"] = [r.asDict() for r in report.violation_text(failing, hit).distinct().orderBy("contract_id", "column_name", "said").limit(a.most).collect()]  # a top-k report
    row["violations"] = [v | {"said": hooks.narrate_violation(v["said"], narrator)} for v in row["violations"]]
    row["diffs"] = [r.asDict() for r in changes.groupBy("contract_id", "classification").count().orderBy("contract_id", "classification").collect()]
    actions = [r.action for r in report.recommendations(failing, changes, subs, outcomes).collect()]
    known = [r.said for r in report.issues(failing, changes, outcomes).orderBy("seq").collect()] if narrator else []
    row["recommendations"] = hooks.advise(actions, known, narrator)
    _dump(row, a.out)
    print(row["narrative"])
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="pactlake")
    sub = p.add_subparsers(required=True)

    def command(f, *required: str, **optional) -> None:
        s = sub.add_parser(f.__name__.removeprefix("cmd_"))
        for r in required:
            s.add_argument(f"--{r}", required=True)
        for o, default in optional.items():
            s.add_argument("--" + o.replace("_", "-"), **({"action": "store_true"} if default is False else {"default": default, **({"type": int} if isinstance(default, int) else {})}))
        s.set_defaults(run=f)

    command(cmd_infer, "data", "id", "out", registry=None, snapshots=None, table=None, approximate=False)
    command(cmd_validate, "contract", "data", "out", mode="AUDIT", baselines=None, samples=5, report_id=None, fail_on_error=False, keep_bad_lines=False, quarantine=None)
    command(cmd_diff, "out", id=None, snapshots=None, old=None, new=None, since=None, registry=None)
    command(cmd_history, "table", "out")
    command(cmd_attribute, "report", "registry", "log", lineage=None, root=None, scripts="outputs/migrate/*.py")
    command(cmd_ai, "data", "out", mode="all", array=None, text="text", preview="content_preview", verdicts=None, traces=None, quarantine=None, log=None, provider=None, centroid=None)
    command(cmd_report, "reports", "out", ai=None, diffs=None, registry=None, most=20, narrator=None)
    a = p.parse_args(argv)
    return a.run(a)


if __name__ == "__main__":
    sys.exit(main())
