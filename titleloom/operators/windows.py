"""Date windows of the batch routines, as a column instead of a loop over queries.

``as_of`` is the time a run counts back from: a timestamp text or a column.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titleloom import fixed_values as fv


def _moment(as_of) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def _weeks_before(as_of, weeks: int) -> Column:
    return _moment(as_of) - F.expr(f"interval {7 * weeks} days")


def _months_before(as_of, months: int) -> Column:
    return _moment(as_of) - F.expr(f"interval {months} months")


def _bounds(as_of, weeks: int, months: tuple[int, int] | None) -> list[tuple[Column, Column]]:
    """(after, up to) of each window, newest first."""
    bounds = [(_weeks_before(as_of, w + 1), _weeks_before(as_of, w)) for w in range(weeks)]
    if months:
        first, last = months
        bounds.append((_months_before(as_of, first), _weeks_before(as_of, weeks)))
        bounds += [(_months_before(as_of, m + 1), _months_before(as_of, m)) for m in range(first, last)]
    return bounds


def _with_window(
    rows: DataFrame, moment: str, bounds: list[tuple[Column, Column]], name: str, only: Collection[int] | None
) -> DataFrame:
    """Rows inside the windows with their window number. Windows touch, so each row is in one.

    One bounded filter on the column reaches the scan; the number is read off the bounds. ``only`` names the windows
    to read: the filter then spans no more than these.
    """
    wanted = sorted(only if only is not None else range(len(bounds)))
    if not wanted:
        return rows.filter("false").withColumn(name, F.lit(None).cast("int"))
    at = F.col(moment)
    number = F.when(at > bounds[0][0], 0)
    for i, (after, _) in enumerate(bounds[1:], 1):
        number = number.when(at > after, i)
    found = rows.filter((at > bounds[wanted[-1]][0]) & (at <= bounds[wanted[0]][1])).withColumn(name, number)
    return found if wanted[-1] - wanted[0] < len(wanted) else found.filter(F.col(name).isin(wanted))


def weekly_windows(
    rows: DataFrame, moment: str, as_of, name: str = "window", only: Collection[int] | None = None
) -> DataFrame:
    """The last 24 weeks, numbered from the newest. Older rows are left out."""
    return _with_window(rows, moment, _bounds(as_of, fv.WEEK_WINDOWS, None), name, only)


def user_windows(
    rows: DataFrame, moment: str, as_of, name: str = "window", only: Collection[int] | None = None
) -> DataFrame:
    """The last 24 weeks, the days left to six months, then six single months: 31 windows."""
    months = (fv.FIRST_MONTH_WINDOW, fv.LAST_MONTH_WINDOW)
    return _with_window(rows, moment, _bounds(as_of, fv.WEEK_WINDOWS, months), name, only)


def window_count(users: bool = False) -> int:
    """How many windows ``weekly_windows`` or, for users, ``user_windows`` have."""
    return fv.WEEK_WINDOWS + (1 + fv.LAST_MONTH_WINDOW - fv.FIRST_MONTH_WINDOW if users else 0)


def recent_jobs_filter(rows: DataFrame, moment: str, as_of) -> DataFrame:
    """Rows after the first day of the month six months ago."""
    today = _moment(as_of).cast("date")
    first = F.add_months(F.trunc(today, "month"), -fv.RECENT_MONTHS)
    return rows.filter(F.col(moment) > first.cast("timestamp"))
