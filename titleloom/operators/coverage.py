"""Logged requests of the title service, and what changed between two versions of it."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titleloom import fixed_values as fv
from titleloom.sources.tables import constant_table

RESPONSE = "map<string,array<struct<normalized_role:string,role_id:bigint>>>"
CLASSES = ("match_none", "match_norm", "differ", "regression", "improvement")


def dedupe_log_requests(logs: DataFrame, time_zone: str = fv.LOG_TIME_ZONE) -> DataFrame:
    """``log_datetime, api_request, api_response``: each request and answer of a day once, at its first time.

    The time is shown in the given zone (the session runs on UTC).
    """
    first = logs.groupBy("year", "month", "day", "request_body", "response_body").agg(F.min("timestamp").alias("ts"))
    shown = F.date_format(F.from_utc_timestamp("ts", time_zone), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return first.select(
        F.concat_ws("-", "year", "month", "day").alias("day"),
        shown.alias("log_datetime"),
        F.col("request_body").alias("api_request"),
        F.col("response_body").alias("api_response"),
    )


def logs_by_date(logs: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Rows of days that are not among the days already written (column ``day``)."""
    if done is None:
        return logs
    return logs.join(F.broadcast(done.select("day").distinct()), "day", "left_anti")


def write_logs_by_date(logs: DataFrame, path: str) -> None:
    """Add one folder per day that the path does not have yet. Tasks write side by side, no shuffle."""
    try:
        done = logs.sparkSession.read.parquet(path).select(F.col("day").cast("string").alias("day"))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        done = None  # nothing written yet
    logs_by_date(logs, done).write.mode("append").partitionBy("day").parquet(path)


def sorted_log_export(logs: DataFrame) -> DataFrame:
    """Logs by time. Equal times are ordered by request and response, which also splits a crowded moment."""
    typed = logs.withColumn("log_datetime", F.to_timestamp("log_datetime"))
    return typed.select("log_datetime", "api_request", "api_response").orderBy(
        "log_datetime", "api_request", "api_response"
    )


def write_sorted_log(logs: DataFrame, path: str) -> None:
    """Sorted logs as gzip-compressed CSV parts with a header; part names follow the order."""
    sorted_log_export(logs).write.csv(
        path, header=True, compression="gzip", escape='"', timestampFormat="yyyy-MM-dd HH:mm:ss.SSSSSS"
    )


def _parsed(log: DataFrame) -> DataFrame:
    """One row per requested title with its first role, and ``valid``; one invalid row for a request without titles."""
    requests = log.select(
        "api_uri",
        *([c for c in ("seq",) if c in log.columns]),
        F.from_json("api_request", "titles array<string>")["titles"].alias("titles"),
        F.from_json("api_response", RESPONSE).alias("answers"),
    )
    has_titles = F.coalesce(F.size("titles") > 0, F.lit(False))
    titles = F.when(has_titles, F.col("titles")).otherwise(F.array(F.lit(None).cast("string")))
    rows = requests.withColumn("has_titles", has_titles).select(
        *[c for c in requests.columns if c != "titles"], "has_titles", F.explode(titles).alias("title")
    )
    roles = F.try_element_at("answers", F.col("title"))
    first = F.try_element_at(roles, F.lit(1))
    answered = F.coalesce(F.size(roles) > 0, F.lit(False))
    complete = F.coalesce((first["normalized_role"] != "") & (first["role_id"] != 0), F.lit(False))
    return rows.select(
        *[c for c in requests.columns if c not in ("titles", "answers")],
        "title",
        first["normalized_role"].alias("normalized_role"),
        first["role_id"].alias("role_id"),
        (F.col("has_titles") & (~answered | complete)).alias("valid"),
    )


def parse_request_response(log: DataFrame) -> DataFrame:
    """``api_uri, title, normalized_role, role_id`` (and ``seq`` where the log has it), one row per requested title.

    Titles without an answer have null roles. Requests without titles and answers without a role are left out
    (see ``count_invalid``).
    """
    return _parsed(log).filter("valid").drop("valid")


def count_invalid(log: DataFrame) -> DataFrame:
    return _parsed(log).agg(F.count_if(~F.col("valid")).alias("invalid"))


def non_normalized_titles(requests: DataFrame) -> DataFrame:
    """``title``: requested titles without a role, sorted, repeats kept.

    The other columns come after the title in the order, so that a frequent title is split over several tasks.
    """
    others = [c for c, kind in requests.dtypes if c != "title" and "map<" not in kind]
    return requests.filter(F.col("role_id").isNull()).orderBy("title", *others).select("title")


# Digits of the shuffled order that one pass counts: at most 65,536 counts come back.
_PASS_DIGITS = 4


def sample_requests(requests: DataFrame, n: int, seed: int, key: Column) -> DataFrame:
    """n requests in an order shuffled by a seed; the same rows on every run.

    The order is a digest of seed and key, then of the other columns. The n-th place is found by radix selection: each
    pass counts the next digits of the rows that share the digits found so far. Then every row sees for itself
    whether it stands before that place, so no task gathers the sample. Only of rows equal in all columns some are
    taken by a limit.
    """
    if n <= 0:
        return requests.limit(0)
    columns = [c for c, kind in requests.dtypes if "map<" not in kind]
    shuffled = F.concat(
        F.md5(F.concat_ws("/", F.lit(seed).cast("string"), key.cast("string"))), F.lpad(F.hex(F.xxhash64(*columns)), 16, "0")
    )
    rows = requests.withColumn("__at", shuffled)
    found, left = "", n
    while len(found) < 48:
        digits = F.substring("__at", len(found) + 1, _PASS_DIGITS)
        counts = sorted(rows.filter(F.startswith("__at", F.lit(found))).groupBy(digits).count().collect())
        for value, count in counts:
            if left <= count:
                break
            left -= count
        else:
            # Only in the first pass, where the rows are fewer than n.
            return requests
        found += value
        if left == count:
            return rows.filter(F.substring("__at", 1, len(found)) <= found).drop("__at")
    equal = rows.filter(F.col("__at") == found).limit(left)
    return rows.filter(F.col("__at") < found).unionByName(equal).drop("__at")


def _last_answers(run: DataFrame, order: str) -> DataFrame:
    answer = F.struct("normalized_role", "role_id")
    return run.groupBy("title").agg(F.max_by(answer, order).alias("answer")).select("title", "answer.*")


def _shown(normalized_role: str, role_id: str) -> Column:
    text = F.concat(F.col(role_id).cast("string"), F.lit(": "), F.coalesce(normalized_role, F.lit("-")))
    return F.when(F.coalesce(role_id, F.lit(0)) != 0, text).otherwise("-")


def compare_runs(remote: DataFrame, local: DataFrame, order: str = "seq") -> DataFrame:
    """``title, remote, local, class`` of every title of two runs; per run the last answer by ``order`` counts."""
    names = {"normalized_role": "remote_role", "role_id": "remote_id"}
    left = _last_answers(remote, order).withColumnsRenamed(names)
    right = _last_answers(local, order).withColumnsRenamed({k: v.replace("remote", "local") for k, v in names.items()})
    before = F.coalesce("remote_id", F.lit(0)) != 0
    after = F.coalesce("local_id", F.lit(0)) != 0
    kind = (
        F.when(~before & ~after, "match_none")
        .when(before & ~after, "regression")
        .when(~before & after, "improvement")
        .when(F.col("remote_id") == F.col("local_id"), "match_norm")
        .otherwise("differ")
    )
    return left.join(right, "title", "full_outer").select(
        "title",
        _shown("remote_role", "remote_id").alias("remote"),
        _shown("local_role", "local_id").alias("local"),
        kind.alias("class"),
    )


def coverage_report(compared: DataFrame) -> DataFrame:
    """``class, titles, share`` for all five classes. Only the five counts are put side by side."""
    counts = compared.groupBy("class").agg(F.count("*").alias("titles"))
    classes = constant_table(compared.sparkSession, "class string", [(c,) for c in CLASSES])
    full = classes.join(counts, "class", "left").select("class", F.coalesce("titles", F.lit(0)).alias("titles"))
    total = full.agg(F.sum("titles").alias("total")).withColumn("one", F.lit(1))
    return (
        full.withColumn("one", F.lit(1)).join(F.broadcast(total), "one")
        .select("class", "titles", F.when(F.col("total") > 0, F.col("titles") / F.col("total")).alias("share"))
    )
