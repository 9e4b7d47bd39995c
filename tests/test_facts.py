"""The stored row of each target: read once, and given up for the joins of the SQL where keys repeat."""

import duckdb
import pytest
from oracle import TABLES, compare

from stagewise import catalog
from stagewise.plans import training
from stagewise.plans.model import Model


@pytest.fixture(scope="module")
def odd(tmp_path_factory, sf):
    """sf0.001 cut to its first orders, with repeated orders and customers, keys without a partner and nulls."""
    out = tmp_path_factory.mktemp("odd")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE TABLE {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    con.execute("DELETE FROM orders WHERE o_orderkey > 200; DELETE FROM lineitem WHERE l_orderkey > 220")
    con.execute("UPDATE orders SET o_orderpriority = NULL WHERE o_orderkey % 17 = 3; UPDATE lineitem SET l_shipdate = NULL WHERE l_linenumber = 2; UPDATE orders SET o_custkey = NULL WHERE o_orderkey % 29 = 5")
    con.execute("UPDATE customer SET c_mktsegment = NULL WHERE c_custkey % 5 = 1")
    for name in ("unique", "repeated"):
        if name == "repeated":
            con.execute("INSERT INTO orders SELECT * FROM orders WHERE o_orderkey % 40 = 1; INSERT INTO customer SELECT * FROM customer WHERE c_custkey % 50 = 7")
        (out / name).mkdir()
        for t in TABLES:
            con.execute(f"COPY {t} TO '{out}/{name}/{t}.parquet' (FORMAT parquet)")
    return out


@pytest.mark.parametrize("keys", ["unique", "repeated"])
def test_odd_keys_match_sql(spark, odd, keys):
    assert (Model(spark, f"{odd}/{keys}").facts is None) == (keys == "repeated")
    for name in ("c6_censoring", "d2_splits", "l1_gate_transitions", "x4_base_rate", "b13_typed_frame", "g5_gate_priors"):
        compare(catalog.QUERIES[name](spark, f"{odd}/{keys}"), f"{odd}/{keys}", catalog.ORACLE_SQL[name])


def test_line_items_are_read_once(spark, sf):
    for name in ("splits", "context", "labels_l1", "relatives"):
        m = Model(spark, sf)
        m.splits  # noqa: B018
        assert not any("lineitem" in f for f in getattr(m, name).inputFiles())


def test_a_gate_reads_its_own_columns(spark, sf):
    m = Model(spark, sf)
    g = training.grid(m, training.HEADLINE)
    plan = g.at(3)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan and "n_3" in plan and "n_4" not in plan
    apart = g.select("target_id", "gate", "in_loss", "y", "n_precedents", "cluster_deposit_rate")
    joined = training.joined_frame(m)
    from stagewise.operators import model as B

    assert apart.exceptAll(B.typed(joined, training.HEADLINE).select(*apart.columns)).count() == 0 and apart.count() == joined.count()
