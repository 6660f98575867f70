"""Access logs of the title service and logs to replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titleloom import fixed_values as fv

ACCESS_LOG = (
    "year string, month string, day string, engine string, status string, request_method string, "
    "request_body string, response_body_custom string, `@timestamp` string"
)
REPLAY_LOG = "log_datetime string, api_uri string, api_request string, api_response string"


def select_access_logs(logs: DataFrame, engine: str, first_day: str, last_day: str) -> DataFrame:
    """Answered requests of one service between two days (``yyyy-mm-dd``, both included).

    Whole months and years outside the range are pruned by the partition columns.
    """
    day = F.concat_ws("-", "year", "month", "day")
    return logs.filter(
        F.col("year").between(first_day[:4], last_day[:4])
        & (day >= first_day)
        & (day <= last_day)
        & (F.col("engine") == engine)
        & F.col("status").isin(*fv.LOG_STATUSES)
        & (F.col("request_method") == fv.LOG_METHOD)
    ).select(
        "year", "month", "day", "request_body", F.col("response_body_custom").alias("response_body"),
        F.to_timestamp("@timestamp").alias("timestamp"),
    )


def read_access_logs(spark: SparkSession, path: str, engine: str, first_day: str, last_day: str) -> DataFrame:
    """As ``select_access_logs``, from JSON lines partitioned by year, month and day."""
    return select_access_logs(spark.read.schema(ACCESS_LOG).json(path), engine, first_day, last_day)


def read_replay_log(spark: SparkSession, path: str) -> DataFrame:
    """``log_datetime, api_uri, api_request, api_response`` from CSV files with a header.

    The URI column is optional, as exported logs have none. Rows without a request are dropped, and so are
    rows without a URI where the column exists. A missing response is an empty object.
    """
    columns = spark.read.option("header", True).csv(path).columns
    schema = ", ".join(f"`{c}` string" for c in columns)
    options = {"header": True, "multiLine": True, "escape": '"'}
    log = spark.read.schema(schema).options(**options).csv(path)
    if "api_uri" in columns:
        log = log.filter(F.col("api_uri") != "")
    else:
        log = log.withColumn("api_uri", F.lit(None).cast("string"))
    return log.filter(F.col("api_request") != "").select(
        "log_datetime", "api_uri", "api_request", F.coalesce("api_response", F.lit("{}")).alias("api_response")
    )
