"""The chain of commands over files."""

import json
import subprocess

import yaml

from pactlake import cli
from pactlake.contract import Clause, Contract
from pactlake.operators import hooks


def test_chain(spark, tmp_path):
    t = lambda *p: str(tmp_path.joinpath(*p))
    good = [{"doc_id": f"00000000-0000-0000-0000-{i:012d}", "kind": "ab"[i % 2], "extracted_facts": [{"confidence": 0.5 + i / 100, "text": f"word{i % 3} more"}]} for i in range(40)]
    bad = [{**r, "extracted_facts": [{**f, "confidence": f["confidence"] * 100} for f in r["extracted_facts"]]} for r in good]
    for name, rows in (("good", good), ("bad", bad)):
        tmp_path.joinpath(f"{name}.jsonl").write_text("\n".join(map(json.dumps, rows)))
    registry = {"subscriptions": [{"contract_id": "docs", "subscriber_id": "s1", "breaking_fields": ["extracted_facts.confidence"], "fields_consumed": ["doc_id"], "validation_mode": "ENFORCE", "tier": 1}]}
    tmp_path.joinpath("registry.yaml").write_text(yaml.safe_dump(registry))
    assert cli.main(["infer", "--data", t("good.jsonl"), "--id", "docs", "--out", t("c"), "--registry", t("registry.yaml"), "--snapshots", t("snap"), "--table", t("table")]) == 0
    check = lambda data, out: cli.main(["validate", "--contract", t("c", "docs.yaml"), "--data", t(data), "--out", t("r", out), "--mode", "ENFORCE", "--baselines", t("snap", "baselines.json")])
    assert check("good.jsonl", "good.json") == 0 and check("bad.jsonl", "violated_bad.json") == 1
    found = {r["check_id"] for r in json.loads(tmp_path.joinpath("r", "violated_bad.json").read_text())["results"] if r["status"] == "HIGH"}
    assert found == {"docs.fact_confidence.range", "docs.fact_confidence.statistical_drift"}
    code = tmp_path.joinpath("code", "outputs", "migrate")
    code.mkdir(parents=True)
    code.joinpath("m.py").write_text("x = 1")
    for words in (["init", "-q"], ["add", "."], ["-c", "user.name=n", "-c", "user.email=e@x", "commit", "-qm", "change the scale"]):
        subprocess.run(["git", *words], cwd=t("code"), check=True)
    assert check("none.jsonl", "violated_none.json") == 0 and json.loads(tmp_path.joinpath("r", "violated_none.json").read_text())["errored"] == 1
    assert cli.main(["attribute", "--report", t("r", "violated_bad.json"), "--registry", t("registry.yaml"), "--log", t("log"), "--root", t("code")]) == 0
    logged = spark.read.json(t("log")).collect()
    assert {r.blast_radius.affected_pipelines[0] for r in logged} == {"s1-pipeline"}
    assert len({r.violation_id for r in logged}) == len(logged) and {r.blast_radius.affected_nodes[0].node_id for r in logged} == {"s1"}
    assert {r.blame_chain[0].commit_message for r in logged} == {"change the scale"} and all(r.source_path.endswith("bad.jsonl") for r in logged)
    assert cli.main(["ai", "--data", t("good.jsonl"), "--out", t("ai.json"), "--mode", "drift", "--array", "extracted_facts"]) == 0
    assert json.loads(tmp_path.joinpath("ai.json").read_text())["embedding_drift"]["status"] == "PASS"
    for _ in range(2):
        assert cli.main(["ai", "--data", t("good.jsonl"), "--out", t("ai2.json"), "--mode", "drift", "--array", "extracted_facts", "--provider", "tests.providers:lengths", "--centroid", t("centroid")]) == 0
    assert json.loads(tmp_path.joinpath("ai2.json").read_text())["embedding_drift"]["status"] == "PASS" and spark.read.parquet(t("centroid")).first().centroid == [10.0, 1.0]
    assert cli.main(["report", "--reports", t("r"), "--out", t("told.json"), "--registry", t("registry.yaml"), "--narrator", "tests.providers:narrator"]) == 0
    told = json.loads(tmp_path.joinpath("told.json").read_text())
    assert told["recommendations"] == ["Do this.", "Then that."] and told["narrative"].startswith("1. Do") and all(v["said"].startswith("1. Do") for v in told["violations"])
    assert cli.main(["report", "--reports", t("r"), "--out", t("summary.json"), "--ai", t("ai.json"), "--registry", t("registry.yaml")]) == 0
    summary = json.loads(tmp_path.joinpath("summary.json").read_text())
    assert any("fact_confidence" in v["said"] and "s1" in v["said"] for v in summary["violations"]) and any("s1-pipeline" in v["said"] for v in summary["violations"]) and "change of scale" in summary["recommendations"][0]
    assert [r["contract_id"] for r in summary["contract_table"]] == ["docs"] and summary["contract_table"][0]["enforcing"] == 1
    assert cli.main(["diff", "--id", "docs", "--out", t("d.json"), "--old", t("c", "docs.yaml"), "--new", t("c", "docs.yaml")]) == 0
    assert json.loads(tmp_path.joinpath("d.json").read_text())["changes"] == []
    assert cli.main(["infer", "--data", t("bad.jsonl"), "--id", "docs", "--out", t("c2"), "--table", t("table")]) == 0
    tmp_path.joinpath("next.jsonl").write_text("\n".join(json.dumps({**r, "kind": "ac"[i % 2]}) for i, r in enumerate(good)))
    assert cli.main(["infer", "--data", t("next.jsonl"), "--id", "docs", "--out", t("c3"), "--table", t("table")]) == 0
    assert cli.main(["history", "--table", t("table"), "--out", t("h")]) == 0
    assert sorted((r.contract_id, r.field, r.change_type) for r in spark.read.json(t("h", "changes")).collect()) == [("docs", "kind", "enum_values_added"), ("docs", "kind", "enum_values_removed")]
    assert [(r.contract_id, r.verdict) for r in spark.read.json(t("h", "verdicts")).collect()] == [("docs", "BREAKING")]
    import shutil

    shutil.copy(t("c2", "docs.yaml"), t("snap", "docs", "99990101T000000Z.yaml"))
    assert cli.main(["diff", "--out", t("diffs"), "--snapshots", t("snap")]) == 0
    assert json.loads(tmp_path.joinpath("diffs", "schema_evolution_docs.json").read_text())["summary"]["total"] == 0


def test_hooks_fall_back():
    c = Contract("c", {"a": Clause(), "b": Clause(format="uuid"), "d": Clause()})

    def annotator(name, clause, near):
        if name == "d":
            raise RuntimeError
        return {"description": ",".join(near)}

    out = hooks.annotate(c, annotator).schema
    assert out["a"].llm_annotations == {"description": "b,d"} and out["b"].llm_annotations is None and out["d"].llm_annotations is None
    assert hooks.narrate(90, "A", {"passed": 9, "total": 10}) == hooks.narrate(90, "A", {"passed": 9, "total": 10}, lambda s: "")


def test_narration_falls_back():
    def failing(request):
        raise RuntimeError

    asked = []
    assert hooks.advise(["a"], ["b"], lambda r: asked.append(r)) == ["a"] == hooks.advise(["a"], [], failing) == hooks.advise(["a"], [], None)
    assert "b" in asked[0] and hooks.advise(["a"], [], lambda r: "1. x\n2. y\n3. z\n4. w") == ["x", "y", "z"]
    assert hooks.narrate_violation("said", failing) == "said" == hooks.narrate_violation("said") and hooks.narrate_violation("said", lambda r: " told ") == "told"
