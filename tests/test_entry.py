"""The driver's contract, with and without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"


def test_works_without_the_training_data_operators(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={"PATH": "/usr/bin:/bin", "HOME": "/tmp"})


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
@pytest.mark.parametrize("name", ["scope_filter", "facets_all", "bm25_topk", "hybrid_rrf_resources", "change_plan", "nearby_events", "facet_codec"])
def test_queries_equal_sql(spark, name):
    import __spark_entry__ as entry

    got = entry.queries()[name](spark, SF).toArrow()
    db = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        db.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = db.sql(entry.oracle_sql()[name]).to_arrow_table()
    cols = sorted(want.column_names)
    assert sorted(got.column_names) == cols
    show = lambda t: sorted(map(repr, zip(*(t.column(c).to_pylist() for c in cols), strict=True)))
    assert show(got) == show(want)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["resource_id", "score", "n_branches", "rank"]
