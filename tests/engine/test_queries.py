"""Every query against its SQL on the smallest tables."""

import importlib.util
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

ROOT = Path(__file__).resolve().parents[2]
SF = "/root/testdata/sf0.001"


def _entry():
    spec = importlib.util.spec_from_file_location("__spark_entry__", ROOT / "__spark_entry__.py")
    module = importlib.util.module_from_spec(spec)
    sys.modules["__spark_entry__"] = module
    spec.loader.exec_module(module)
    return module


ENTRY = _entry()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        c.sql(f"create view {path.stem} as select * from '{path}'")
    return c


def canon(df):
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True) if len(df) else df


@pytest.mark.parametrize("name", sorted(ENTRY.oracle_sql()))
def test_agrees_with_sql(spark, db, name):
    ours, theirs = ENTRY.queries()[name](spark, SF).toPandas(), db.sql(ENTRY.oracle_sql()[name]).df()
    pd.testing.assert_frame_equal(canon(ours), canon(theirs), check_dtype=False)


def test_entry(spark):
    assert ENTRY.entry(spark).count() > 0


def test_plans_read_whole_tables(spark):
    """No sampling, and a limit only where it is what the query reports."""
    reports = {"browse_page", "trending", "product_lookup", "similar_collab", "similar_content", "similar_hybrid"}
    for name in ("interaction_matrix", "knn_recs", "popularity_recs", "content_recs", "collaborative_recs_2f", "eval_models", "tuning_grid_full", "metrics_at_k", "split_train", "tfidf_word", "embedding_topk", "facets", *reports):
        plan = ENTRY.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "Sample" not in plan, name
        assert name in reports or "GlobalLimit" not in plan, name
