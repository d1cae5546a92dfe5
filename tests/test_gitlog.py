"""Commits as a data source."""

import json
import os
import subprocess

import pytest

from pactlake.sources import gitlog, readers

DAYS = ["2024-03-01T10:00:00Z", "2024-01-01T10:00:00Z", "2024-03-03T10:00:00Z"]  # the second commit's clock was wrong


@pytest.fixture(scope="module")
def clone(tmp_path_factory):
    root = tmp_path_factory.mktemp("clone")
    git = lambda *words, **env: subprocess.run(["git", *words], cwd=root, check=True, env=os.environ | env)
    git("init", "-q")
    for i, day in enumerate(DAYS):
        for name in ("a.txt", "b.txt")[: 2 if i else 1]:
            (root / name).write_text(f"{name} {i}\n")
        git("add", ".")
        git("-c", "user.name=n|x", "-c", "user.email=e@x", "commit", "-qm", f"step | {i}", GIT_AUTHOR_DATE=day, GIT_COMMITTER_DATE=day)
    return str(root)


@pytest.fixture
def log(spark, clone):
    spark.dataSource.register(gitlog.GitLog)
    spark.conf.set(gitlog.PUSHDOWN, "true")
    yield lambda files, **options: spark.read.format("gitlog").options(root=clone, files=json.dumps(files), **options).load()
    spark.conf.unset(gitlog.PUSHDOWN)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_files_are_partitions_newest_first(log):
    every = log(["a.txt", "b.txt", "none"])
    assert every.rdd.getNumPartitions() == 3
    assert [(r.place, r.seq, r.message) for r in every.orderBy("place", "seq").collect()] == [(0, 0, "step | 2"), (0, 1, "step | 1"), (0, 2, "step | 0"), (1, 0, "step | 2"), (1, 1, "step | 1")]
    first = every.where("place = 0 AND seq = 2").first()
    assert (first.author, first.email, first.ts, first.file_path, len(first.commit_hash)) == ("n|x", "e@x", "2024-03-01 10:00:00 +0000", "a.txt", 40)


@pytest.mark.parametrize("bound, messages", [(">= timestamp'2024-03-01 10:00:00'", "20"), ("> timestamp'2024-03-01 10:00:00'", "2"), (">= timestamp'2024-03-01 10:00:00.5'", "2"), ("> timestamp'2024-03-01 09:59:59.5'", "20"), ("> timestamp'2024-03-03 10:00:00'", ""), ("< timestamp'2024-02-01 10:00:00'", "1")])
def test_the_age_goes_into_git(spark, log, bound, messages):
    asked = log(["a.txt"]).where(f"committed {bound}")
    assert [r.message[-1] for r in asked.orderBy("seq").collect()] == list(messages)
    said = asked._sc._jvm.PythonSQLUtils.explainString(asked._jdf.queryExecution(), "formatted")
    assert ("PushedFilters: [Greater" in said) == bound.startswith(">")
    spark.conf.set(gitlog.PUSHDOWN, "false")
    assert [r.message[-1] for r in log(["a.txt"], push="false").where(f"committed {bound}").orderBy("seq").collect()] == list(messages)


def test_failures_give_no_rows(spark, log, clone, tmp_path):
    assert log([]).count() == 0 and log(["a.txt"], timeout=0.000001).count() == 0
    assert readers.commits(spark, ["a.txt"], str(tmp_path)).count() == 0 and readers.commits(spark, ["a.txt"], str(tmp_path / "none")).count() == 0


def test_commits_of_some_days(spark, clone):
    for push in ("true", "false"):
        spark.conf.set(gitlog.PUSHDOWN, push)
        assert readers.commits(spark, ["a.txt", "b.txt"], clone).count() == 0
        assert readers.commits(spark, ["a.txt", "b.txt"], clone, days=100_000).count() == 5
    spark.conf.unset(gitlog.PUSHDOWN)
