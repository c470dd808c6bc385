from __future__ import annotations

import importlib.util
from pathlib import Path

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
spec = importlib.util.spec_from_file_location("__spark_entry__", Path(__file__).parent.parent / "__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
NAMES = ["t16_chunk_score", "t22_extraction_score", "c3_sentence_chunks", "d3_scored_with_duplicates", "p06_rules", "r01_authority", "p11_relevance", "k02_top_k", "a03_staleness_report", "s06_rows_to_chunks"]


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


def same(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in cur.fetchall())
    assert sorted(names) == cols
    assert sorted(repr([plain(r[c]) for c in cols]) for r in df.collect()) == want


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    same(spark, name)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_sql_has_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
