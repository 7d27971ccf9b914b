"""Every query of the training-data operators that SQL can say, against its SQL."""

import math
import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402
from oddlog.llm.queries import LLM_ORACLES, LLM_QUERIES  # noqa: E402

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
ORACLES = dict(LLM_ORACLES)
QUERIES = {**LLM_QUERIES, "pipeline": corpus_pipeline.run}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    for path in sorted(Path(SF).glob("*.parquet")):
        found.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return found


def cells(row):
    return tuple("nan" if isinstance(v, float) and math.isnan(v) else float(v) if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((cells(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=repr)
    frame = con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})")
    want = sorted((cells(r) for r in frame.fetchall()), key=repr)
    assert len(got) == len(want)
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    assert not wrong, wrong[:3]
