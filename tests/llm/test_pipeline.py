import corpus_pipeline as cp
from tests.conftest import SF
from tests.llm.test_packing import check, ids_of


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    names = [n for n, _ in cp.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    frames = {}
    from pactlake.llm.common import settle

    for name, stage in cp.STAGES:
        frames[name] = docs = settle(stage(spark, docs, SF))
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {n: {r.doc_id for r in frames[n].select("doc_id").collect()} for n in names[:4]}
    good = [i for i, r in labels.items() if r.quality == 1]
    assert sum(i in kept["quality"] for i in good) / len(good) > 0.95
    texts = [r.text for r in frames["exact_dedup"].collect()]
    assert len(texts) == len(set(texts)) == len({r.text for r in frames["quality"].collect()})
    assert kept["near_dedup"] <= kept["exact_dedup"] <= kept["quality"]
    mixed = frames["mixing"].collect()
    check(frames["packing"].collect(), [(r.doc_id, i) for r, i in zip(mixed, ids_of([r.text for r in mixed]))])


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_run_leaves_only_what_its_result_needs(spark):
    from pactlake.llm.common import settled

    before = settled()
    out = cp.run(spark, SF)
    assert out.columns[:5] == ["doc_id", "piece", "start", "length", "ids_crc32"] and out.count() > 0
    left = [p.rsplit("/", 1)[1].split("-")[1] for p in settled() if p not in before]
    assert left[0] == "mixing" and not {"quality", "exact_dedup", "near_dedup", "texts", "posteriors"} & set(left)


def test_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows and clashing names go through every stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None), (900_001, None), (900_002, ""), (900_003, "word " * 100_000), (900_004, "tie"), (900_004, "tie")], "doc_id long, text string")
    docs = docs.unionByName(odd, allowMissingColumns=True).selectExpr("*", "'x' AS th", "1 AS shard", "2 AS _doc", "'y' AS key", "struct(doc_id AS a) AS row")
    for name, stage in cp.STAGES:
        columns = docs.columns
        docs = stage(spark, docs, SF).cache() if name == "packing" else cp.settle(stage(spark, docs, SF), name)
        if name != "packing":
            assert docs.columns == columns
        if name in ("exact_dedup", "near_dedup"):
            assert docs.where("coalesce(text, '') = ''").count() <= 1 and docs.where("text = 'tie'").count() <= 1
    assert docs.count() > 0
