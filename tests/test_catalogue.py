"""Every registered query of the core against its SQL in DuckDB, and the driver's contract."""

import os
import subprocess
import sys
import zlib
from collections import Counter

import pytest

from stratalog.functions import codec
from stratalog.plans import catalogue

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.exists(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{name}')")
    return con


def rounded(v):
    return round(v, 6) if isinstance(v, float) else v


@needs_data
@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_and_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = Counter(tuple(rounded(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert found == Counter(tuple(rounded(r[names.index(c)]) for c in columns) for r in result.fetchall())


@needs_data
def test_block_checksums(spark):
    names = {r["c_custkey"]: r["c_name"] for r in spark.read.parquet(f"{DATA}/customer.parquet").collect()}
    found = {r["c_custkey"]: r["crc"] for r in catalogue.QUERIES["crc_masked"](spark, DATA).collect()}
    assert found == {k: codec.mask(zlib.crc32(n.encode() + b"\0")) for k, n in names.items()}


@needs_data
def test_filters_say_no_to_most_others(spark):
    rows = catalogue.QUERIES["bloom_membership"](spark, DATA).collect()
    own, others = [r for r in rows if r["key"].isdigit()], [r for r in rows if not r["key"].isdigit()]
    assert len(own) == len(others) > 0 and all(r["may_hold"] for r in own) and sum(r["may_hold"] for r in others) < 0.05 * len(others)


@needs_data
def test_no_inequality_joins_in_the_plans(spark):
    """One-row sides apart, no plan compares all rows with all."""
    for name in ("find_file", "file_overlaps", "files_for_key", "next_level_overlap", "gc_base_level", "approx_size"):
        plan = catalogue.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_contract_without_the_training_data_part(tmp_path):
    """With that subpackage unimportable, all other queries are still there."""
    code = "import sys; sys.modules['stratalog.llm'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, len(e.oracle_sql()))"
    run = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    assert run.stdout.split()[-3:] == [str(len(catalogue.QUERIES)), "False", str(len(catalogue.ORACLES))]


def test_names_of_queries_and_sql():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == {"crc_masked"}
