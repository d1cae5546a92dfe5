"""Commits of files as a Spark data source: a partition a file, with the age filter pushed into git.

    spark.dataSource.register(GitLog)
    spark.read.format("gitlog").option("root", repo).option("files", json.dumps(paths)).load().where("committed >= current_date() - 14")
"""

from __future__ import annotations

import json
import math
import subprocess
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition

#: What git returns for an option that it doesn't know.
UNKNOWN_OPTION = 129

#: Let Spark hand filters to sources that are written in Python.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


class FileHistory(InputPartition):
    """One file's commits; place is its place in the list of files."""

    def __init__(self, place: int, path: str):
        super().__init__(place)
        self.place, self.path = place, path


class GitLogReader(DataSourceReader):
    def __init__(self, root: str, files: list[str], timeout: float):
        self.root, self.files, self.timeout = root, files, timeout
        self.since: int | None = None  # in seconds since 1970

    def partitions(self) -> list[InputPartition]:
        return [FileHistory(i, path) for i, path in enumerate(self.files)]

    def read(self, partition: FileHistory) -> Iterator[tuple]:
        """(commit_hash, author, email, ts, committed, message, file_path, place, seq) of a file, newest first; nothing where git fails or takes too long."""
        if not isinstance(partition, FileHistory):  # no files, no histories
            return
        command = ["git", "log", "--follow", "--format=%H%x1f%an%x1f%ae%x1f%ai%x1f%ct%x1f%s"]
        age = [f"--since-as-filter=@{self.since}"] if self.since and self.since > 0 else []  # git knows no times before 1970
        try:
            said = self.run([*command, *age, "--", partition.path])
            if said.returncode == UNKNOWN_OPTION and age:  # by a git before 2.37
                said = self.run([*command, "--", partition.path])
        except (OSError, subprocess.SubprocessError):
            return
        if said.returncode:
            return
        lines = (line.split("\x1f", 5) for line in said.stdout.decode("utf-8", "replace").split("\n") if line)
        for seq, (sha, author, email, ts, at, message) in enumerate(lines):
            if self.since is None or int(at) >= self.since:
                yield sha, author, email, ts, datetime.fromtimestamp(int(at), tz=timezone.utc), message, partition.path, partition.place, seq

    def run(self, command: list[str]) -> subprocess.CompletedProcess:
        return subprocess.run(command, cwd=self.root, capture_output=True, timeout=self.timeout)


class PushingGitLogReader(GitLogReader):
    """Takes lower bounds on `committed`, the latest of which git applies; commits are timed in whole seconds, so none is left for Spark."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("committed",) and isinstance(f.value, datetime):
                at = (f.value if f.value.tzinfo else f.value.replace(tzinfo=timezone.utc)).timestamp()
                first = math.ceil(at) if isinstance(f, GreaterThanOrEqual) else math.floor(at) + 1
                self.since = first if self.since is None else max(self.since, first)
            else:
                yield f


class GitLog(DataSource):
    """Options: root (a clone that executors can reach), files (a JSON list of paths), timeout (seconds, 10), push (false: no filters go into git)."""

    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return "commit_hash string, author string, email string, ts string, committed timestamp, message string, file_path string, place int, seq int"

    def reader(self, schema) -> DataSourceReader:
        kind = PushingGitLogReader if self.options.get("push", "true").lower() == "true" else GitLogReader
        return kind(self.options.get("root", "."), json.loads(self.options.get("files", "[]")), float(self.options.get("timeout", 10)))
