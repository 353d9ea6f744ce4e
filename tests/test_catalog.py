"""The driver contract, and a cross-section of the queries beside their SQL."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from check import normal

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
SOME = [
    "dom_node_list", "xpath_of_elements", "interactive_elements", "forms", "nested_expandables", "metric_changes",
    "monitoring_summary", "stability_point", "expansion_summary", "content_analysis", "page_summary", "changed_definitions",
    "repository_totals", "commit_pairs", "unified_diffs", "write_definition_diffs", "stream_activity",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


def test_contract(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 120
    assert entry.entry(spark).count() == 50
    readme = open(os.path.join(os.path.dirname(entry.__file__), "README.md")).read()
    assert not [n for n in queries if not re.search(rf"\b{n}\b", readme)]


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, con, name):
    got = normal(entry.queries()[name](spark, FOLDER).toPandas())
    want = normal(con.sql(entry.oracle_sql()[name]).df())
    assert got[0] == want[0]
    assert got[1] == want[1] and got[1]
