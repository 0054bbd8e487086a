"""Written steps: keys, publishing, and reading without planning."""

import os

from carelog import session
from carelog.plans import catalog
from carelog.session import checkpoint_dir, fingerprint, step_table


def test_nested_files_change_the_fingerprint(spark, tmp_path):
    deep = tmp_path / "t.parquet" / "a=1" / "b=2"
    deep.mkdir(parents=True)
    (deep / "x").write_text("one")
    first = fingerprint(spark, [str(tmp_path / "t.parquet")])
    assert fingerprint(spark, [str(tmp_path / "t.parquet")]) == first
    (deep / "y").write_text("two")
    second = fingerprint(spark, [str(tmp_path / "t.parquet")])
    (deep / "y").write_text("three")
    assert len({first, second, fingerprint(spark, [str(tmp_path / "t.parquet")])}) == 3
    assert fingerprint(spark, [str(tmp_path / "no such")]) == fingerprint(spark, [str(tmp_path / "none here")])


def test_a_finished_table_is_not_planned_again(spark, tmp_path):
    name, made = f"once-{os.path.basename(tmp_path)}", []

    def make():
        made.append(1)
        return spark.range(5).selectExpr("id", "cast(id as decimal(18,9)) d", "array(id) a")
    first = step_table(spark, name, "k-1", make)
    again = step_table(spark, name, "k-1", make)
    assert len(made) == 1 and again.schema == first.schema and sorted(again.collect()) == sorted(first.collect())
    step_table(spark, name, "k-2", make)
    assert len(made) == 2
    assert step_table(spark, name, "k-1", make).count() == 5  # a running job's table stays
    assert len(made) == 2


def test_two_writers_leave_one_whole_table(spark, tmp_path):
    name = f"race-{os.path.basename(tmp_path)}"

    def slow():
        step_table(spark, name, "k-1", lambda: spark.range(7).selectExpr("id"))  # another writer is done first
        return spark.range(3).selectExpr("id")
    assert step_table(spark, name, "k-1", slow).count() == 7
    assert step_table(spark, name, "k-1", slow).count() == 7
    where, fs = session._path(spark, f"{checkpoint_dir(spark)}/carelog-tables/{name}")
    assert [f.getPath().getName() for f in fs.listStatus(where)] == ["k-1"]


def test_a_change_reaches_the_later_steps_only(monkeypatch):
    def versions():
        catalog.step_version.cache_clear()
        return {s: catalog.step_version(s) for s in catalog.STEPS}
    before, real = versions(), catalog._code
    monkeypatch.setattr(catalog, "_code", lambda *m: real(*m) + ("changed" if "sofa" in m else ""))
    after = versions()
    assert {s for s in before if before[s] != after[s]} == {"sofa", "combined", "day12", "analysis", "smooth_fits"}
    monkeypatch.undo()
    assert versions() == before


def test_steps_by_stay_join_without_a_shuffle(spark):
    """Broadcasts off: only the match of index pair and compliance row, by (stay, bucket), is dealt anew."""
    from carelog.plans import combined as CB
    from tests.conftest import SF001
    study = catalog.Study(spark, SF001)
    study.combined()
    t = study.tables("vitalperiodic", "lab", "diagnosis")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        df = CB.combined(study.first_pfratio(), study.lungcompliance(), study.sofa(), t["vitalperiodic"], t["lab"], t["diagnosis"])
        plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    shuffled = 0
    for k, line in enumerate(plan):
        if "FileScan" not in line:
            continue
        above, d = [], depth(line)
        for up in reversed(plan[:k]):  # the nodes that this scan feeds
            if depth(up) < d:
                above.append(up)
                d = depth(up)
        shuffled += any("Exchange" in up for up in above)
    assert sum("SortMergeJoin" in line for line in plan) == 6
    assert shuffled == 2, shuffled  # the two sides of that match; SOFA, vitals, labs, flags and the index pair are read in place


def test_bucket_counts():
    assert session.bucket_count(0) == 8 and session.bucket_count(100 << 40) == 1 << 16
    assert session.bucket_count(10 << 30) == 64
