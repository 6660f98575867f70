"""Routines that work through their date windows in steps and go on where a stopped run ended.

The ledger is an append-only table with one row per window and state. A step first writes the rows with the roles found
and enters its windows as ``matched``, with the place of these rows; then it writes its outputs and enters them as
``finished``. A rerun leaves finished windows alone, takes matched ones up from the rows they have, and reads only the
others. All outputs of a step may be repeated: keyed tables take the same rows again without a change, and messages
and counts have a folder per step. One run at a time may use a ledger.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Collection
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titleloom.operators.keyed_tables import BUCKETS, upsert_flags_at, write_roles_at
from titleloom.operators.windows import user_windows, weekly_windows, window_count
from titleloom.operators.writeback import job_index_messages, user_index_messages
from titleloom.plans.routines import pending_with_roles, routine_counts
from titleloom.session import new_shared_path
from titleloom.sources.gazetteers import Gazetteer
from titleloom.sources.pending import pending_cvs, pending_jobs, pending_work_exp
from titleloom.sources.tables import constant_table

LEDGER = "routine string, as_of string, window int, state string, rows string"
MATCHED, FINISHED = "matched", "finished"
# Windows of one step: the work that a stopped run may have to repeat.
TOGETHER = 8


@dataclass(frozen=True)
class Outputs:
    """Folders of a resumable routine: ``roles`` and ``flags`` are tables of ``write_keyed_table``."""

    roles: str
    flags: str
    messages: str
    counts: str
    ledger: str
    buckets: int = BUCKETS


@dataclass(frozen=True)
class Routine:
    """What tells the three routines apart."""

    name: str
    windows: int
    id_column: str
    names: dict[str, str]
    key: str
    flag_keys: tuple[str, ...]
    messages: Callable[[DataFrame], DataFrame]


_USER_NAMES = {"user_id": "usr_id", "cv_id": "cur_id", "work_exp_id": "curexpprof_id"}
_USER_KEYS = ("usr_id", "cur_id", "curexpprof_id")
JOBS = Routine("jobs", window_count(), "job_id", {"job_id": "vag_id"}, "vag_id", ("vag_id",), job_index_messages)
CVS = Routine("cvs", window_count(users=True), "user_id", _USER_NAMES, "cur_id", _USER_KEYS, user_index_messages)
WORK_EXP = Routine(
    "work_exp", window_count(users=True), "user_id", _USER_NAMES, "curexpprof_id", _USER_KEYS, user_index_messages
)


def _enter(spark: SparkSession, path: str, rows: list[tuple]) -> None:
    constant_table(spark, LEDGER, rows).coalesce(1).write.mode("append").parquet(path)


def ledger_states(spark: SparkSession, path: str, routine: str, as_of: str) -> dict[int, tuple[str, str]]:
    """Window to its last state and the place of its rows. A ledger that does not exist yet is begun."""
    constant_table(spark, LEDGER, []).write.mode("ignore").parquet(path)
    entries = spark.read.schema(LEDGER).parquet(path).filter((F.col("routine") == routine) & (F.col("as_of") == as_of))
    # Two rows a window at most.
    return {r["window"]: (r["state"], r["rows"]) for r in sorted(entries.collect(), key=lambda r: r["state"] == FINISHED)}


def _steps(states: dict[int, tuple[str, str]], windows: int, together: int) -> list[tuple[list[int], str | None]]:
    """Open windows in order, newest first: those that were matched together, and up to ``together`` others."""
    steps: list[tuple[list[int], str | None]] = []
    for window in range(windows):
        state, place = states.get(window, (None, None))
        if state == FINISHED:
            continue
        last = steps[-1] if steps else None
        if last and last[1] == place and last[0][-1] == window - 1 and (place or len(last[0]) < together):
            last[0].append(window)
        else:
            steps.append(([window], place))
    return steps


def run_open_windows(
    routine: Routine,
    as_of: str,
    pending: Callable[[Collection[int]], DataFrame],
    catalogue: DataFrame,
    lists: Gazetteer,
    out: Outputs,
    parent: DataFrame | None = None,
    together: int = TOGETHER,
    at_most: int | None = None,
    **options,
) -> list[int]:
    """Work through the windows that the ledger does not show as finished; the windows finished by this call.

    ``pending(windows)`` gives the waiting rows of some windows, and is asked for open windows only. ``at_most`` limits
    the number of steps. Options as in ``pending_with_roles``. A key in several windows keeps the role of the oldest.
    """
    spark = catalogue.sparkSession
    done: list[int] = []
    for windows, place in _steps(ledger_states(spark, out.ledger, routine.name, as_of), routine.windows, together)[:at_most]:
        if place is None:
            place = new_shared_path(spark, f"matched-{routine.name}")
            found = pending_with_roles(pending(windows), routine.id_column, catalogue, lists, **options)
            found = found.withColumnsRenamed({k: v for k, v in routine.names.items() if k in found.columns})
            if "curexpprof_id" in routine.flag_keys and "curexpprof_id" not in found.columns:
                found = found.withColumn("curexpprof_id", F.lit(0))
            found.write.parquet(place)
            _enter(spark, out.ledger, [(routine.name, as_of, w, MATCHED, place) for w in windows])
        _write_outputs(spark, routine, as_of, windows[0], spark.read.parquet(place), out, parent)
        _enter(spark, out.ledger, [(routine.name, as_of, w, FINISHED, place) for w in windows])
        done += windows
    return done


def _write_outputs(
    spark: SparkSession, routine: Routine, as_of: str, window: int, rows: DataFrame, out: Outputs, parent: DataFrame | None
) -> None:
    normal = rows.filter(F.col("eligible") & F.col("role_id").isNotNull()).withColumnRenamed("role_id", "cargo_id")
    keys = list(routine.flag_keys)
    write_roles_at(spark, out.roles, normal.select(routine.key, "cargo_id"), routine.key, parent, buckets=out.buckets)
    upsert_flags_at(spark, out.flags, normal.select(*keys, "cargo_id"), keys, as_of, buckets=out.buckets)
    step = f"routine={routine.name}/as_of={re.sub('[^0-9]', '', as_of)}/first_window={window}"
    routine.messages(normal).write.mode("overwrite").parquet(f"{out.messages}/{step}")
    routine_counts(rows, routine.key, parent).write.mode("overwrite").parquet(f"{out.counts}/{step}")


def resume_jobs_routine(
    jobs: DataFrame, job_display: DataFrame, role_rows: DataFrame, as_of: str, catalogue: DataFrame, lists: Gazetteer,
    out: Outputs, **options,
) -> list[int]:
    """``run_jobs_routine`` in place and in steps; see ``run_open_windows``."""

    def pending(windows):
        recent = weekly_windows(jobs, "data_entrada", as_of, only=windows).drop("window")
        return pending_jobs(recent, job_display, role_rows, as_of)

    return run_open_windows(JOBS, as_of, pending, catalogue, lists, out, **options)


def resume_cvs_routine(
    users: DataFrame, cvs: DataFrame, role_rows: DataFrame, as_of: str, catalogue: DataFrame, lists: Gazetteer,
    out: Outputs, **options,
) -> list[int]:
    """``run_cvs_routine`` in place and in steps; see ``run_open_windows``."""

    def pending(windows):
        return pending_cvs(users, user_windows(cvs, "data_alteracao", as_of, only=windows).drop("window"), role_rows)

    return run_open_windows(CVS, as_of, pending, catalogue, lists, out, **options)


def resume_work_exp_routine(
    users: DataFrame, cvs: DataFrame, work_exp: DataFrame, role_rows: DataFrame, as_of: str, catalogue: DataFrame,
    lists: Gazetteer, out: Outputs, **options,
) -> list[int]:
    """``run_work_exp_routine`` in place and in steps; see ``run_open_windows``."""

    def pending(windows):
        recent = user_windows(cvs, "data_alteracao", as_of, only=windows).drop("window")
        return pending_work_exp(users, recent, work_exp, role_rows)

    return run_open_windows(WORK_EXP, as_of, pending, catalogue, lists, out, parent=work_exp, **options)
