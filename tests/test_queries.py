"""Named queries against DuckDB, plans, and the entry module with and without the optional subpackage."""

import contextlib
import io
import re
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from spatiarc.plans.oracle import ORACLE_SQL
from spatiarc.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
REPO = Path(__file__).resolve().parents[1]


def rows(frame):
    plain = frame[sorted(frame.columns)].astype(object)
    return sorted(map(repr, plain.where(plain.notna(), None).itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF}/events.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, oracle, name):
    mine, theirs = QUERIES[name](spark, SF).toPandas(), oracle.execute(ORACLE_SQL[name]).df()
    assert set(mine.columns) == set(theirs.columns)
    assert rows(mine) == rows(theirs)


@pytest.mark.parametrize("name", ["radius_domain", "radius_domain_categories", "radius_coverage", "vectors_radius_sphere", "vectors_radius_euclidean", "radius_min_coverage", "pairwise_radius"])
def test_radius_queries_take_every_sample_and_step(spark, name):
    whole = QUERIES[name](spark, SF).toPandas()
    assert set(whole["sample"]) == {"click", "error", "purchase", "signup", "view"}
    if "step" in whole:
        assert set(whole["step"]) == {25.0, 50.0, 75.0, 100.0, 125.0, 150.0}


def test_queries_without_sql(spark):
    assert set(QUERIES) - set(ORACLE_SQL) == {"binstat_mann_whitney", "paired_wilcoxon", "proportion_test"}
    assert QUERIES["binstat_mann_whitney"](spark, SF).count() == 5


def test_goldens(spark):
    """The cohort means of the flagship query."""
    got = {(r.feature, r.step): (round(r.min_djaccard, 5), round(r.max_djaccard, 5)) for r in QUERIES["vectors_grid_cohort"](spark, SF).collect()}
    assert got["inflammation_score", 2.0] == (-0.09332, 0.16772) and got["inflammation_score", 12.0] == (-0.20954, 0.20412)
    assert round({r.feature: r.vector_len for r in QUERIES["vector_magnitude"](spark, SF).collect()}["inflammation_score"], 6) == 0.50456


def plan(df):
    with contextlib.redirect_stdout(out := io.StringIO()):
        df.explain("formatted")
    return out.getvalue()


def test_plans(spark):
    one = plan(QUERIES["grid_max"](spark, SF))
    assert "user_id" in one and "props" not in "".join(re.findall("ReadSchema.*", one)) and "Python" not in one
    flagship = plan(QUERIES["vectors_grid_cohort"](spark, SF))
    assert "CartesianProduct" not in flagship and "Python" not in flagship
    assert "events.parquet" not in flagship  # the raster was written; points are not scanned again


def test_entry_without_the_subpackage(tmp_path):
    ignore = shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py")
    shutil.copytree(REPO, tmp_path / "copy", ignore=ignore)
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) < set(e.queries()); assert not [q for q in e.queries() if q.startswith('op')]; print(len(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=120, check=False)
    assert done.returncode == 0 and int(done.stdout) == len(QUERIES), done.stderr
