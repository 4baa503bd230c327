"""Git history as a table."""

from __future__ import annotations

import subprocess

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from quarry import schema

_COLUMNS = ["commit", "author", "ts", "added", "deleted", "path"]


def parse_log(text: str) -> pd.DataFrame:
    """Rows of ``git log --numstat`` with a '---' line, hash, author and time before each commit; binary files are left out."""
    rows, head, expect = [], ["", "", 0], 0
    for line in text.splitlines():
        if line == "---":
            head, expect = ["", "", 0], 3
        elif expect == 3:
            head[0], expect = line, 2
        elif expect == 2:
            head[1], expect = line, 1
        elif expect == 1:
            head[2], expect = int(line) if line.lstrip("-").isdigit() else 0, 0
        elif line.strip():
            parts = line.split("\t")
            if len(parts) == 3 and "-" not in parts[:2]:
                rows.append((*head, *(int(x) if x.isdigit() else 0 for x in parts[:2]), parts[2]))
    return pd.DataFrame(rows, columns=_COLUMNS)


def git_log(spark: SparkSession, root: str) -> tuple[DataFrame, str]:
    """The log of a repository, and '' or why there is none."""
    command = ["git", "-C", root, "log", "--numstat", "--no-renames", "--pretty=format:---%n%H%n%an%n%at"]
    try:
        done = subprocess.run(command, capture_output=True, text=True, errors="replace", check=False)
        reason = "" if done.returncode == 0 else done.stderr.strip() or "git log failed"
    except OSError as e:
        done, reason = None, str(e)
    rows = parse_log(done.stdout) if done is not None and not reason else pd.DataFrame(columns=_COLUMNS)
    return spark.createDataFrame(rows, schema.GIT_LOG) if len(rows) else spark.createDataFrame([], schema.GIT_LOG), reason
