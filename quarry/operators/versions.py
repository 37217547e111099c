"""Snapshots, rollback and the audit log: Parquet tables under one root folder, and one numbered log of all commits."""

from __future__ import annotations

import getpass
import json
import os
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY_SHAPE = ("number long, id string, timestamp timestamp, user string, action string, details string, "
               "table string, path string, name string, comment string")
DIGITS = 20


class Conflict(ValueError):
    """Another writer committed first."""


def _entry_path(root: str, number: int) -> str:
    return f"{root}/_log/{number:0{DIGITS}d}.json"


def _create_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with its whole content, unless it exists: of several writers exactly one succeeds.

    On a local disk a finished file is linked under its name, elsewhere the store's own create-unless-exists decides.
    """
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.getScheme() == "file":
        name = store.makeQualified(target).toUri().getPath()
        os.makedirs(os.path.dirname(name), exist_ok=True)
        draft = f"{os.path.dirname(name)}/.{uuid.uuid4().hex}"
        with open(draft, "w", encoding="utf-8") as out:
            out.write(text)
        try:
            os.link(draft, name)
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
        return True
    try:
        out = store.create(target, False)
    except Py4JJavaError as problem:
        if "Exists" in problem.java_exception.getClass().getName():
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def entries(spark: SparkSession, root: str) -> DataFrame:
    """The commit log: an entry per commit, numbered from 1; an entry that a writer left unfinished has no id and is left out."""
    try:
        return spark.read.schema(ENTRY_SHAPE).json(f"{root}/_log").filter(F.col("id").isNotNull())
    except AnalysisException:  # before the first entry
        return spark.createDataFrame([], ENTRY_SHAPE)


def _newest(spark: SparkSession, root: str) -> int:
    """The highest number taken, from the names in the log's folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_log")
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(folder):
        return 0
    taken = [f.getPath().getName().split(".")[0] for f in store.listStatus(folder)]
    return max((int(n) for n in taken if n.isdigit()), default=0)


def commit(spark: SparkSession, root: str, action: str, user: str | None = None, details: str = "", table: str | None = None, path: str | None = None,
           name: str | None = None, comment: str | None = None, after: int | None = None) -> int:
    """Add an entry to the log under the next free number, and return it.

    Numbers decide what is newest, never clocks: an entry is created only where its number is free, and a writer that finds
    it taken looks again. With ``after``, the number of the entry that set ``table`` when its writer read it, a commit by
    someone else to the same table in between is a ``Conflict``; commits to other tables only cost another try.
    """
    entry = {"id": uuid.uuid4().hex, "timestamp": datetime.now(timezone.utc).isoformat(), "user": user or getpass.getuser(), "action": action,
             "details": details, "table": table, "path": path, "name": name, "comment": comment}
    while True:
        number = _newest(spark, root) + 1
        if after is not None and version(spark, root, table) != after:
            raise Conflict(f"table '{table}' was changed by another commit")
        if _create_absent(spark, _entry_path(root, number), json.dumps({"number": number} | entry)):
            return number


def log_action(spark: SparkSession, root: str, user: str | None, action: str, details: str = "") -> None:
    commit(spark, root, action, user, details)


def audit_log(log: DataFrame, user: str | None = None, action: str | None = None, since: datetime | str | None = None,
              until: datetime | str | None = None, limit: int = 50) -> DataFrame:
    """Newest entries first; user exact, action by substring (case ignored), times inclusive."""
    if user is not None:
        log = log.filter(F.col("user") == user)
    if action is not None:
        log = log.filter(F.contains(F.lower("action"), F.lower(F.lit(action))))
    if since is not None:
        log = log.filter(F.col("timestamp") >= F.lit(since).cast("timestamp"))
    if until is not None:
        log = log.filter(F.col("timestamp") <= F.lit(until).cast("timestamp"))
    newest = [F.col("number").desc_nulls_last()] if "number" in log.columns else []
    return log.orderBy(*newest, F.col("timestamp").desc_nulls_last(), "id").limit(limit)


def read_audit_log(spark: SparkSession, root: str, **wanted) -> DataFrame:
    return audit_log(entries(spark, root), **wanted)


def job_history(runs: DataFrame, task_id: int | None = None, errors_only: bool = False, limit: int = 20) -> DataFrame:
    """Latest runs of (id, task_id, task_name, start_time, status, error) first."""
    if task_id is not None:
        runs = runs.filter(F.col("task_id") == task_id)
    if errors_only:
        runs = runs.filter(F.col("status") != "success")
    return runs.orderBy(F.col("start_time").desc_nulls_last(), "id").limit(limit)


def _set_by(spark: SparkSession, root: str, table: str) -> tuple[int, str] | None:
    latest = entries(spark, root).filter((F.col("table") == table) & F.col("path").isNotNull()).orderBy(F.desc("number")).select("number", "path").first()
    return None if latest is None else (latest["number"], latest["path"])


def version(spark: SparkSession, root: str, table: str) -> int:
    """The number of the entry that last set the table, 0 before the first."""
    latest = _set_by(spark, root, table)
    return latest[0] if latest else 0


def current_path(spark: SparkSession, root: str, table: str) -> str:
    latest = _set_by(spark, root, table)
    if latest is None:
        raise ValueError(f"no table '{table}' under {root}")
    return latest[1]


def read_current(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.parquet(current_path(spark, root, table))


def audited_write(df: DataFrame, root: str, table: str, action: str, user: str | None = None, details: str = "", after: int | None = None) -> str:
    """Write a new version of a table; one commit points the table at it and says who did what.

    The earlier version stays in place, so ``df`` may be derived from it; ``after``, what ``version`` said when it was read,
    makes sure that no other writer's version is passed over (``Conflict`` if there is one).
    """
    path = f"{root}/{table}/{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    commit(df.sparkSession, root, action, user, details or f"table={table}", table, path, after=after)
    return path


def update(spark: SparkSession, root: str, table: str, change: Callable[[DataFrame], DataFrame], action: str, user: str | None = None, tries: int = 10) -> str:
    """Read the table, change it and commit; where another writer came first, start again from that one's version."""
    for turn in range(tries):
        now = version(spark, root, table)
        try:
            return audited_write(change(read_current(spark, root, table)), root, table, action, user, after=now)
        except Conflict:
            if turn + 1 == tries:
                raise


def snapshot_path(root: str, table: str, name: str) -> str:
    return f"{root}/_snapshots/{name}/{table}"


def snapshot(df: DataFrame, root: str, table: str, name: str, comment: str = "", user: str | None = None) -> DataFrame:
    """Copy a table under a name; an existing name is an error."""
    spark, path = df.sparkSession, snapshot_path(root, table, name)
    try:
        df.write.mode("errorifexists").parquet(path)
    except AnalysisException as problem:
        raise ValueError(f"snapshot '{name}' of '{table}' exists already") from problem
    commit(spark, root, "snapshot", user, f"table={table} name={name}", table, name=name, comment=comment)
    return spark.read.parquet(path)


def snapshots(spark: SparkSession, root: str) -> DataFrame:
    """(name, original_table, snapshot_path, timestamp, comment) of every snapshot."""
    made = entries(spark, root).filter("action = 'snapshot' AND name IS NOT NULL")
    place = F.concat(F.lit(f"{root}/_snapshots/"), "name", F.lit("/"), "table")
    return made.select("name", F.col("table").alias("original_table"), place.alias("snapshot_path"), "timestamp", "comment")


def rollback(spark: SparkSession, root: str, table: str, name: str, dry_run: bool = False, user: str | None = None) -> DataFrame:
    """Point the table at a snapshot, which never changes; ``dry_run`` only compares row counts."""
    try:
        saved = spark.read.parquet(snapshot_path(root, table, name))
    except AnalysisException as problem:
        raise ValueError(f"no snapshot '{name}' of '{table}'") from problem
    if dry_run:
        now, then = read_current(spark, root, table).count(), saved.count()
        return spark.createDataFrame([(now, then)], "current_rows long, snapshot_rows long")
    commit(spark, root, "rollback", user, f"table={table} name={name}", table, snapshot_path(root, table, name), name=name)
    return read_current(spark, root, table)


def view_materialize(spark: SparkSession, name: str, query: str, as_table: str | None = None) -> DataFrame:
    """Name a query; with ``as_table`` (a path) also write its result there and read that."""
    spark.sql(query).createOrReplaceTempView(name)
    if as_table is None:
        return spark.table(name)
    spark.table(name).write.mode("overwrite").parquet(as_table)
    return spark.read.parquet(as_table)
