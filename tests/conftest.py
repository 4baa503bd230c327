from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quarry.session import local_session

    folder = tmp_path_factory.mktemp("shared")
    conf = {"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": f"file://{folder}", "spark.driver.memory": "4g", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))}
    return local_session("4", **conf)


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        p = Path(SF, f"{t}.parquet")
        con.sql(f"create view {t} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def values(rows, columns):
    """Rows as sorted tuples of text, doubles to nine digits."""

    def plain(v):
        return "" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in rows)


@pytest.fixture(scope="session")
def same_rows(spark, duck):
    """Runs a query and its SQL at sf0.01 and compares columns and rows."""

    def check(query, sql, least=1):
        df = query(spark, SF)
        got = [r.asDict() for r in df.collect()]
        want = duck.sql(sql).df()
        assert sorted(df.columns) == sorted(want.columns)
        left, right = values(got, df.columns), values(want.to_dict("records"), df.columns)
        assert len(left) >= least
        assert left == right

    return check
