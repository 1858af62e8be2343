"""Path queries on graphs where the two symbols are not joined along calls, or too far apart."""

import duckdb
import pytest
from harness import difference

from mnemoloom.plans.catalogue import CATALOGUE

_CHAIN = [1, *range(100, 112), 42]  # 13 calls
GRAPHS = {
    "against calls": [(1, 5), (42, 5)],
    "13 calls": list(zip(_CHAIN, _CHAIN[1:])),
    "12 calls": list(zip(_CHAIN[1:], _CHAIN[2:])) + [(1, 101)],
    "nothing": [(1, 5), (42, 6)],
}


@pytest.fixture(params=sorted(GRAPHS))
def tables(request, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE TABLE lineitem AS SELECT * FROM (VALUES " + ", ".join(f"({a}::BIGINT, {b}::BIGINT, 1)" for a, b in GRAPHS[request.param]) + ") t(l_partkey, l_orderkey, l_linenumber)")
    con.execute(
        """CREATE TABLE part AS SELECT DISTINCT k AS p_partkey, 'part ' || k AS p_name, 'B' AS p_brand, 'SMALL' AS p_type, 1 AS p_size
           FROM (SELECT l_partkey AS k FROM lineitem UNION SELECT l_orderkey FROM lineitem)"""
    )
    for t in ("part", "lineitem"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    return con, str(tmp_path)


@pytest.mark.parametrize("name", ["shortest_path_len", "shortest_path_steps"])
def test_paths_as_in_sql(spark, tables, name):
    con, path = tables
    assert difference(spark, con, CATALOGUE[name], path) is None
