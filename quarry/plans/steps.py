"""Workflows of named operator steps."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Mapping

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quarry.operators import clean, columns_ops, density, fuzzy, geo, integrity, isolation, ml, neighbours, rows, stats, windows
from quarry.session import write_out
from quarry.sources.tables import read_table

OPERATORS: dict[str, Callable[..., DataFrame]] = {
    f.__name__: f for f in (
        columns_ops.rename_col, columns_ops.drop_col, columns_ops.cast_col, columns_ops.flatten_json, columns_ops.rule_flags,
        rows.head, rows.tail, rows.sample, rows.filter_rows, rows.search, rows.sort, rows.distinct, rows.value_counts,
        rows.find_nulls, rows.dups,
        stats.groupby, stats.groupby_pivot, stats.pivot, stats.crosstab, stats.describe,
        windows.moving_avg, windows.rank, windows.bin,
        clean.impute_mode, clean.impute_group, clean.regex_replace, clean.drop_outliers, clean.map_values, clean.trim,
        geo.geo_validate, geo.geo_distance, geo.centroid, geo.bounds,
        geo.geocode, geo.reverse_geocode, neighbours.nearest, neighbours.knn_impute, density.dbscan,
        fuzzy.harmonize, fuzzy.fuzzy_clusters, ml.kmeans, isolation.isolation_forest,
        integrity.encrypt_col, integrity.decrypt_col, integrity.anonymize, integrity.scan_pii, integrity.fingerprint,
    )
}


def read_workflow(text: str) -> dict:
    """A workflow from JSON, or from YAML where a YAML reader is installed."""
    try:
        return json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as problem:
            raise ValueError("not JSON, and no YAML reader is installed") from problem
        return yaml.safe_load(text)


#: Operators that only extend the plan. All others may run jobs while they build their result.
LAZY = frozenset((
    "rename_col drop_col rule_flags head tail filter_rows search sort distinct value_counts find_nulls dups "
    "regex_replace trim geo_validate geo_distance centroid bounds encrypt_col decrypt_col anonymize scan_pii"
).split())


def _is_lazy(step: Mapping) -> bool:
    # a cast that keeps the column where it fails has to look first
    return step["op"] in LAZY or step["op"] == "cast_col" and step.get("args", {}).get("on_error", "fail") != "ignore"


class StepFailed(ValueError):
    """A step failed; ``status`` has the states of all steps."""

    def __init__(self, message: str, status: list[dict]):
        super().__init__(message)
        self.status = status


def _rows_of(seen: Observation) -> int | None:
    """What an observation has counted, None where the plan no longer holds its step."""
    found: list[int] = []
    reader = threading.Thread(target=lambda: found.append(seen.get["rows"]), daemon=True)
    reader.start()
    reader.join(timeout=5)
    return found[0] if found else None


def _run(df: DataFrame) -> str | None:
    """Run a plan to the end without keeping its rows; the error's text if it fails."""
    try:
        df.write.format("noop").mode("overwrite").save()
    except PySparkException as problem:
        return str(problem)
    return None


def run_steps(df: DataFrame, workflow: Mapping | str, continue_on_error: bool = False, settle: bool = True) -> tuple[DataFrame, list[dict]]:
    """Apply the workflow's steps in order. Also returns each step's status.

    Steps that only extend the plan run together: each is observed, and the one job that writes the last one's result gives
    the rows that came out of all of them. A step that has to run jobs of its own starts from a written table and is written.
    A status is success, with ``rows``, only once the step has run; failed, with the error; or not run. Where a job fails at run
    time, the plans up to each of its steps are tried by halves until the first failing step is found; the steps before
    it are settled. A failing step stops the run (``StepFailed``, which holds all states), or is skipped with
    ``continue_on_error``. Without ``settle`` nothing is run for the status: steps are planned. ``rows`` counts what a step has
    handed on in that job, so before a ``head`` it may be less than the whole table.
    An argument {"table": path} stands for the table at that path.
    """
    workflow = read_workflow(workflow) if isinstance(workflow, str) else workflow
    steps = list(workflow.get("steps", []))
    status = [{"name": step.get("name", f"Step {i + 1}"), "status": "not run", "error": None, "rows": None} for i, step in enumerate(steps)]
    pending: list[tuple[int, DataFrame, Observation]] = []  # steps planned since the last written table ``df``

    def fail(i: int, error: str) -> None:
        status[i] |= {"status": "failed", "error": error}
        if not continue_on_error:
            raise StepFailed(f"step '{status[i]['name']}' failed: {error}", status)

    def settled(base: DataFrame) -> DataFrame:
        """Run the pending steps in one job; where one fails at run time, those before it, then the rest without it."""
        while pending:
            last = pending[-1][1]
            try:
                base, held = write_out(last), pending[:]
            except PySparkException as problem:
                good, bad = 0, len(pending)  # the first ``good`` steps run, the first ``bad`` do not
                error = str(problem)
                while bad - good > 1:
                    middle = (good + bad) // 2
                    again = _run(planned(base, [i for i, _, _ in pending[:middle]])[-1][1])
                    good, bad, error = (middle, bad, error) if again is None else (good, middle, again)
                broken = pending[bad - 1][0]
                rest = [i for i, _, _ in pending if i > broken]
                pending[:] = planned(base, [i for i, _, _ in pending[:good]])
                base = settled(base)
                fail(broken, error)
                pending[:] = planned(base, rest)
                continue
            pending.clear()
            for i, _, seen in held:
                status[i] |= {"status": "success", "rows": _rows_of(seen)}
        return base

    def planned(base: DataFrame, which: list[int]) -> list[tuple[int, DataFrame, Observation]]:
        found = []
        for i in which:
            seen = Observation()
            try:
                base = applied(base, i).observe(seen, F.count(F.lit(1)).alias("rows"))
            except (ValueError, TypeError, PySparkException) as problem:
                fail(i, str(problem))
                continue
            found.append((i, base, seen))
        return found

    def applied(base: DataFrame, i: int) -> DataFrame:
        args = {k: read_table(base.sparkSession, v["table"]) if isinstance(v, Mapping) and set(v) == {"table"} else v for k, v in steps[i].get("args", {}).items()}
        return OPERATORS[steps[i]["op"]](base, **args)

    for i, step in enumerate(steps):
        now = pending[-1][1] if pending else df
        if step.get("op") not in OPERATORS:
            df = settled(df) if settle else df
            fail(i, f"no operator '{step.get('op')}'")
        elif not settle:
            try:
                df = applied(df, i)
                status[i]["status"] = "planned"
            except (ValueError, TypeError, PySparkException) as problem:
                fail(i, str(problem))
        elif _is_lazy(step):
            seen = Observation()
            try:
                made = applied(now, i).observe(seen, F.count(F.lit(1)).alias("rows"))
            except (ValueError, TypeError, PySparkException) as problem:
                df = settled(df)
                fail(i, str(problem))
                continue
            pending.append((i, made, seen))
        else:
            df = settled(df)
            try:
                df = write_out(applied(df, i))
                status[i] |= {"status": "success", "rows": df.count()}
            except (ValueError, TypeError, PySparkException) as problem:
                fail(i, str(problem))
    return settled(df), status
