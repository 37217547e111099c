"""The commit log under several writers, and what a workflow says about steps that ran, failed or never came to run."""

import threading

import pytest
from pyspark.sql import functions as F

from quarry.operators import versions
from quarry.plans import steps
from quarry.plans.steps import StepFailed, run_steps


def test_one_of_two_writers_wins_and_the_other_starts_again(spark, tmp_path):
    root = str(tmp_path)
    versions.audited_write(spark.range(1), root, "t", "load")
    seen, met = [], threading.Barrier(2)

    def add(name):
        def change(df):
            if not seen.count(name):  # both read the same version first
                seen.append(name)
                met.wait(60)
            return df.unionAll(spark.createDataFrame([(len(name),)], "id long"))
        versions.update(spark, root, "t", change, f"add {name}", name)

    writers = [threading.Thread(target=add, args=(n,)) for n in ("ann", "robert")]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(r["id"] for r in versions.read_current(spark, root, "t").collect()) == [0, 3, 6]
    log = versions.entries(spark, root).orderBy("number").collect()
    assert [r["number"] for r in log] == [1, 2, 3] and {r["user"] for r in log[1:]} == {"ann", "robert"}


def test_a_change_on_an_old_version_is_a_conflict(spark, tmp_path):
    root = str(tmp_path)
    versions.audited_write(spark.range(1), root, "t", "load")
    read_at = versions.version(spark, root, "t")
    versions.audited_write(spark.range(9), root, "other", "load")  # another table does not matter
    versions.audited_write(spark.range(2), root, "t", "more", after=read_at)
    with pytest.raises(versions.Conflict):
        versions.audited_write(spark.range(3), root, "t", "late", after=read_at)
    assert versions.read_current(spark, root, "t").count() == 2
    assert [r["action"] for r in versions.read_audit_log(spark, root).collect()] == ["more", "load", "load"]


def test_many_writers_take_every_number_once(spark, tmp_path):
    root, taken = str(tmp_path), []
    writers = [threading.Thread(target=lambda i=i: taken.extend(versions.commit(spark, root, "note", f"u{i}") for _ in range(5))) for i in range(6)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(taken) == list(range(1, 31)) and versions.entries(spark, root).count() == 30


def test_the_clock_does_not_decide(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    versions.audited_write(spark.range(1), root, "t", "load")

    class Back(versions.datetime):
        @classmethod
        def now(cls, tz=None):
            return versions.datetime.fromisoformat("1999-01-01T00:00:00+00:00")

    monkeypatch.setattr(versions, "datetime", Back)
    versions.audited_write(spark.range(5), root, "t", "later, by a clock that runs behind")
    versions.audited_write(spark.range(7), root, "t", "at the same time")
    assert versions.read_current(spark, root, "t").count() == 7
    assert [r["number"] for r in versions.read_audit_log(spark, root).collect()] == [3, 2, 1]


def test_an_unfinished_entry_is_passed_over(spark, tmp_path):
    root = str(tmp_path)
    versions.audited_write(spark.range(4), root, "t", "load")
    (tmp_path / "_log" / f"{2:020d}.json").write_text("")
    assert versions.commit(spark, root, "note") == 3 and versions.read_current(spark, root, "t").count() == 4


def _jobs(spark, name, work):
    spark.sparkContext.setJobGroup(name, "")
    try:
        work()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_ten_narrow_steps_are_one_job(spark):
    df = spark.range(50).select(F.col("id").cast("int").alias("i"), F.concat(F.lit(" x"), "id").alias("t"))
    narrow = [{"op": "trim", "args": {"col": "t"}}, {"op": "filter_rows", "args": {"where": "i > 4"}}, {"op": "rename_col", "args": {"old": "t", "new": "u"}},
              {"op": "regex_replace", "args": {"col": "u", "pattern": "x", "repl": "y"}}, {"op": "anonymize", "args": {"col": "u", "method": "mask", "chars": 1}},
              {"op": "filter_rows", "args": {"where": "i < 40"}}, {"op": "rename_col", "args": {"old": "u", "new": "t"}}, {"op": "trim", "args": {"col": "t"}},
              {"op": "search", "args": {"term": "1"}}, {"op": "drop_col", "args": {"col": "i"}}]
    held = []
    jobs = _jobs(spark, "narrow", lambda: held.append(run_steps(df, {"steps": narrow})))
    out, status = held[0]
    assert jobs == 1 and out.columns == ["t"]
    assert [s["rows"] for s in status] == [50, 45, 45, 45, 45, 35, 35, 35, out.count(), out.count()] and {s["status"] for s in status} == {"success"}


def test_a_step_that_fails_at_run_time_is_found(spark):
    df = spark.range(20).select(F.col("id").cast("int").alias("i"), F.lit(" a ").alias("t"), F.when(F.col("id") == 7, "seven").otherwise(F.col("id").cast("string")).alias("s"))
    work = [{"name": "a", "op": "filter_rows", "args": {"where": "i > 2"}}, {"name": "b", "op": "trim", "args": {"col": "t"}},
            {"name": "c", "op": "cast_col", "args": {"col": "s", "to": "integer", "on_error": "fail"}},  # one value is no number, which shows only when it runs
            {"name": "d", "op": "filter_rows", "args": {"where": "i < 15"}}, {"name": "e", "op": "trim", "args": {"col": "t"}}]
    with pytest.raises(StepFailed, match="step 'c'") as told:
        run_steps(df, {"steps": work})
    assert [s["status"] for s in told.value.status] == ["success", "success", "failed", "not run", "not run"]
    assert [s["rows"] for s in told.value.status[:2]] == [17, 17] and "seven" in told.value.status[2]["error"]
    out, status = run_steps(df, {"steps": work}, continue_on_error=True)
    assert [s["status"] for s in status] == ["success", "success", "failed", "success", "success"]
    assert out.count() == 12 and [s["rows"] for s in status] == [17, 17, None, 12, 12]


def test_listed_lazy_steps_start_no_jobs(spark):
    assert steps.LAZY <= set(steps.OPERATORS)
    df = spark.createDataFrame([(1, "a@b.org", 10.0, 20.0)], "i int, t string, lat double, lon double")
    args = {"rename_col": {"old": "t", "new": "u"}, "drop_col": {"col": "t"}, "rule_flags": {"rules": {"i": {"min": 0}}}, "head": {"n": 1, "order_by": "i"},
            "tail": {"n": 1, "order_by": "i"}, "filter_rows": {"where": "i > 0"}, "search": {"term": "a"}, "sort": {"col": "i"}, "distinct": {"col": "i"},
            "value_counts": {"col": "i"}, "find_nulls": {}, "dups": {"col": "i", "order_by": "t"}, "regex_replace": {"col": "t", "pattern": "a", "repl": "b"},
            "trim": {"col": "t"}, "geo_validate": {"lat": "lat", "lon": "lon"}, "geo_distance": {"lat": "lat", "lon": "lon", "target_lat": 0.0, "target_lon": 0.0},
            "centroid": {"lat": "lat", "lon": "lon"}, "bounds": {"lat": "lat", "lon": "lon"}, "encrypt_col": {"col": "t", "key": "0123456789abcdef"},
            "decrypt_col": {"col": "t", "key": "0123456789abcdef"}, "anonymize": {"col": "t", "method": "hash"}, "scan_pii": {"key": "i"}}
    for op in sorted(steps.LAZY):
        assert _jobs(spark, f"lazy {op}", lambda: steps.OPERATORS[op](df, **args[op])) == 0, op
