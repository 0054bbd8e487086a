"""The derived tables: one deal of each base row set, buckets that keep their size, only the tables a query reads."""

import pytest

from carelog.functions.rules import OXYGEN_SUPPORT_RULES, classify
from carelog.plans import catalog
from carelog.plans.catalog import QUERIES
from carelog.plans.oxygen import support_events
from carelog.sources import fixtures
from carelog.sources.fixtures import DERIVED, derive, stay_buckets
from carelog.sources.tables import EICU_SCHEMAS


@pytest.fixture
def tables(spark, tmp_path):
    """Driver tables with repeated and null keys, items without an order and orders without items."""
    folder = tmp_path / "in"
    items = [(k % 40 if k % 11 else None, k, k % 7, k % 4, float(k % 50)) for k in range(400)] + [(900, 1, 1, 1, 1.0)]
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(f"{folder}/lineitem.parquet")
    orders = [(k % 45, k % 9 if k % 10 else None, "F", 10.0 * k, "1-URGENT") for k in range(60)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(k % 9, "BUILDING") for k in range(12)], "c_custkey long, c_mktsegment string").write.parquet(f"{folder}/customer.parquet")
    return str(folder)


def test_written_tables_hold_the_projections(spark, tables):
    lazy, written = derive(spark, tables, materialize=False), derive(spark, tables)
    assert set(written) == set(DERIVED)
    for name in DERIVED:
        assert written[name].dtypes == lazy[name].dtypes
        assert written[name].exceptAll(lazy[name]).isEmpty() and lazy[name].exceptAll(written[name]).isEmpty(), name
        files = written[name].inputFiles()
        buckets = {f.rsplit("_", 1)[1].split(".")[0] for f in files}
        assert len(files) == len(buckets), name  # written in place: one file a bucket


def test_a_base_is_dealt_once(spark, tables, monkeypatch):
    dealt = []
    real = fixtures.step_table
    monkeypatch.setattr(fixtures, "step_table", lambda s, name, key, make, by=None, buckets=0, placed=False:
                        real(s, name, key, lambda: (placed or dealt.append(name), make())[1], by, buckets, placed))
    derive(spark, tables)
    assert sorted(dealt) == ["base-C", "base-L", "base-O"]


def test_buckets_keep_their_size(spark, tmp_path, monkeypatch):
    for total, least in ((100 << 20, 8), (1 << 30, 64), (6 << 30, 384)):
        monkeypatch.setattr(fixtures, "source_bytes", lambda *a, total=total: total)
        found = stay_buckets(spark, str(tmp_path))
        assert found >= least and total / found <= 16 << 20


@pytest.mark.parametrize("name, wanted", [
    ("pipe_mech_vent", {"respiratorycare", "respiratorycharting", "treatment", "patient"}),
    ("pipe_oxygen", {"respiratorycharting", "nursecharting", "treatment", "patient"}),
    ("pipe_support_dedupe", {"respiratorycharting", "nursecharting", "treatment"})])
def test_only_the_tables_that_are_read(spark, tables, monkeypatch, name, wanted):
    made = []
    real = catalog.derive
    monkeypatch.setattr(catalog, "derive", lambda s, d, names=None: (made.extend(names or DERIVED), real(s, d, names))[1])
    assert QUERIES[name](spark, tables).count() >= 0 and set(made) == wanted


def test_rule_code_stays_compilable(spark):
    """The JVM interprets methods of more than 8000 bytes."""
    t = {n: spark.createDataFrame([], EICU_SCHEMAS[n]) for n in ("respiratorycharting", "nursecharting", "treatment")}
    plan = support_events(t["respiratorycharting"], t["nursecharting"], t["treatment"])._jdf.queryExecution().executedPlan()
    code = getattr(spark.sparkContext._jvm.org.apache.spark.sql.execution.debug, "package").codegenStringSeq(plan)
    sizes = [code.apply(i)._3().maxMethodCodeSize() for i in range(code.size())]
    assert all(s < 8000 for s in sizes), sizes


def test_lists_of_substrings(spark):
    texts = spark.createDataFrame([(k, t) for k, t in enumerate(["set vt", "hyperventilation", "vent", None, "a nasal cannula"])], "k int, t string")
    found = texts.select("k", classify("t", OXYGEN_SUPPORT_RULES, lower=False).alias("sql"), classify("t", OXYGEN_SUPPORT_RULES).alias("built"))
    assert [tuple(r) for r in found.orderBy("k").collect()] == [(0, 4, 4), (1, None, None), (2, 2, 2), (3, None, None), (4, 1, 1)]
