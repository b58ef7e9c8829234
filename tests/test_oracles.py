"""Every query against its SQL oracle on the smallest tables."""

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from veilframe.queries.catalogue import REGISTRY

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
KINDS = {"int": "int32", "bigint": "int64", "string": "string", "double": "double", "boolean": "bool", "date": "date32[day]"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    return f"{value:.9g}" if isinstance(value, float) else str(value)


def ordered(table):
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return names, sorted(tuple(map(normal, row)) for row in zip(*columns))


OWN = set(REGISTRY.queries)  # the pipeline operators have tests of their own


@pytest.mark.parametrize("name", sorted(OWN & set(entry.oracle_sql())))
def test_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF_DIR)
    want = duck.sql(entry.oracle_sql()[name]).to_arrow_table()
    kinds = {f.name: KINDS[f.dataType.simpleString()] for f in df.schema}
    assert kinds == {f.name: str(f.type).replace("large_", "") for f in want.schema}
    assert ordered(df.toArrow()) == ordered(want)


@pytest.mark.parametrize("name", sorted(OWN - set(entry.oracle_sql())))
def test_runs(spark, name):
    assert entry.queries()[name](spark, SF_DIR).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).columns == ["doc_id", "redacted", "entity_count", "entities"]


def test_entry_without_the_pipeline_folders(tmp_path):
    """The rest imports and has its queries where those folders are not."""
    root = Path(__file__).resolve().parents[1]
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "veilframe", tmp_path / "veilframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True)
    assert run.stdout.split() == [str(len(REGISTRY.queries)), str(len(REGISTRY.oracles))], run.stderr
