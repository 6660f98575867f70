"""Logs, the comparison of two runs, and the checks of rule lists."""

from __future__ import annotations

import gzip
import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from titleloom.operators import coverage as cov
from titleloom.operators import lint
from titleloom.operators.catalogue import build_catalogue
from titleloom.operators.normalize import Steps
from titleloom.sources import logs


def entry(day, at, request, response="{}", status="200", method="POST", engine="titles"):
    return {
        "engine": engine, "status": status, "request_method": method, "request_body": request,
        "response_body_custom": response, "@timestamp": f"2024-01-{day}T{at}Z",
    }


def write_logs(folder, entries):
    for i, (day, row) in enumerate(entries):
        path = folder / "year=2024" / "month=01" / f"day={day}"
        path.mkdir(parents=True, exist_ok=True)
        (path / f"part-{i}.json").write_text(json.dumps(row) + "\n", "utf-8")


def test_access_logs_from_partitioned_json(spark, tmp_path):
    rows = [
        ("05", entry("05", "01:00:00.250", "a")), ("05", entry("05", "00:30:00.125", "a")),
        ("06", entry("06", "01:00:00", "a", status="204")), ("06", entry("06", "02:00:00", "b", status="500")),
        ("06", entry("06", "02:00:00", "c", method="GET")), ("06", entry("06", "02:00:00", "d", engine="x")),
        ("09", entry("09", "02:00:00", "e")),
    ]
    write_logs(tmp_path, rows)
    found = logs.read_access_logs(spark, str(tmp_path), "titles", "2024-01-05", "2024-01-08")
    deduped = cov.dedupe_log_requests(found).orderBy("day").collect()
    assert [tuple(r)[:3] for r in deduped] == [
        ("2024-01-05", "2024-01-04 21:30:00.125000", "a"), ("2024-01-06", "2024-01-05 22:00:00.000000", "a")
    ]


def test_days_already_written_are_kept(spark, tmp_path):
    path = str(tmp_path / "days")
    schema = "day string, log_datetime string, api_request string, api_response string"
    cov.write_logs_by_date(spark.createDataFrame([("2024-01-01", "x", "old", "{}")], schema), path)
    again = [("2024-01-01", "x", "new", "{}"), ("2024-01-02", "y", "new", "{}")]
    cov.write_logs_by_date(spark.createDataFrame(again, schema), path)
    found = {(str(r.day), r.api_request) for r in spark.read.parquet(path).collect()}
    assert found == {("2024-01-01", "old"), ("2024-01-02", "new")}


def test_sorted_export_reads_back_without_a_uri(spark, tmp_path):
    path = tmp_path / "export"
    request = '{"titles": ["a, \\"b\\"\nc"]}'
    rows = [("2024-01-02 00:00:00.5", request, "{}"), ("2024-01-01 00:00:00", "q", None)]
    frame = spark.createDataFrame(rows, "log_datetime string, api_request string, api_response string")
    cov.write_sorted_log(frame, str(path))
    parts = sorted(path.glob("part-*.csv.gz"))
    text = "".join(gzip.open(p, "rt").read() for p in parts)
    assert text.index("2024-01-01") < text.index("2024-01-02")
    back = logs.read_replay_log(spark, str(path)).orderBy("log_datetime").collect()
    assert [(r.api_uri, r.api_request, r.api_response) for r in back] == [(None, "q", "{}"), (None, request, "{}")]


def test_replay_log_with_uris(spark, tmp_path):
    (tmp_path / "log.csv").write_text(
        'log_datetime,api_uri,api_request,api_response\nd1,/u,"{""titles"": [""a""]}",\nd2,,"{}","{}"\nd3,/u,,x\n', "utf-8"
    )
    found = [tuple(r) for r in logs.read_replay_log(spark, str(tmp_path / "log.csv")).collect()]
    assert found == [("d1", "/u", '{"titles": ["a"]}', "{}")]


def test_requests_are_parsed_title_by_title(spark):
    good = json.dumps({"a": [{"normalized_role": "A", "role_id": 3, "seniority": []}, {"normalized_role": "B", "role_id": 4}], "b": []})
    rows = [
        ("/u", '{"titles": ["a", "b", "c"]}', good), ("/u", '{"titles": []}', "{}"), ("/u", "{}", "{}"), ("/u", "not json", "{}"),
        ("/u", '{"titles": ["d"]}', '{"d": [{"normalized_role": "", "role_id": 4}]}'),
        ("/u", '{"titles": ["d"]}', '{"d": [{"normalized_role": "D", "role_id": 0}]}'),
        ("/u", '{"titles": ["e"]}', "broken"),
    ]
    frame = spark.createDataFrame(rows, "api_uri string, api_request string, api_response string")
    found = cov.parse_request_response(frame)
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, [
        ("/u", "a", "A", 3), ("/u", "b", None, None), ("/u", "c", None, None), ("/u", "e", None, None)
    ]))
    assert cov.count_invalid(frame).first().invalid == 5
    assert [r.title for r in cov.non_normalized_titles(found).collect()] == ["b", "c", "e"]


def test_samples_repeat(spark):
    frame = spark.range(1000)
    one = {r.id for r in cov.sample_requests(frame, 50, 7, F.col("id")).collect()}
    assert one == {r.id for r in cov.sample_requests(frame.repartition(9), 50, 7, F.col("id")).collect()} and len(one) == 50
    assert one != {r.id for r in cov.sample_requests(frame, 50, 8, F.col("id")).collect()}
    assert cov.sample_requests(frame, 5000, 7, F.col("id")).count() == 1000


def test_comparison_of_runs(spark):
    schema = "title string, normalized_role string, role_id long, seq int"
    remote = spark.createDataFrame([("a", None, None, 1), ("b", "B", 2, 1), ("c", "C", 3, 1), ("d", "D", 4, 1), ("e", "E", 5, 1), ("e", None, 0, 2)], schema)
    local = spark.createDataFrame([("a", None, None, 1), ("b", "B", 2, 1), ("c", None, 9, 1), ("d", None, None, 1), ("e", "E", 5, 1)], schema)
    compared = cov.compare_runs(remote, local)
    assert {r.title: (r.remote, r.local, r["class"]) for r in compared.collect()} == {
        "a": ("-", "-", "match_none"), "b": ("2: B", "2: B", "match_norm"), "c": ("3: C", "9: -", "differ"),
        "d": ("4: D", "-", "regression"), "e": ("-", "5: E", "improvement"),
    }
    report = {r["class"]: (r.titles, r.share) for r in cov.coverage_report(compared.filter("title <> 'a'")).collect()}
    assert report == {"match_none": (0, 0.0), "match_norm": (1, 0.25), "differ": (1, 0.25), "regression": (1, 0.25), "improvement": (1, 0.25)}


def test_rule_order_equals_a_search_of_all_later_lines(spark, monkeypatch):
    monkeypatch.setattr(lint, "RANGE_LINES", 8)
    rng = random.Random(6)
    words = ["a", "b", "c", "dd"]
    texts = [",".join(" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(texts, 1)), "line int, text string")
    found = {(r.line, r.term): (r.later_lines, r.next_line) for r in lint.rule_order_lint(frame).collect()}
    expected = {}
    for i, text in enumerate(texts, 1):
        for term in set(text.split(",")[1:]):
            later = [j for j, t in enumerate(texts, 1) if j > i and re.search(f"( |,|^){term}( |,|$)", t)]
            if later:
                expected[i, term] = (len(later), later[0])
    assert found == expected and len(found) > 50


def test_ambiguous_lines(spark, lists):
    roles = spark.createDataFrame([(2, "Advogado", "main"), (3, "Médico", "main")], "role_id int, title string, source string")
    frame = spark.createDataFrame([(1, "medico,advogado,medica"), (2, "advogado,lawyer"), (3, "x,y")], "line int, text string")
    found = lint.rule_ambiguity_lint(frame, build_catalogue(roles, lists), lists, Steps(correct_typos=False))
    assert [tuple(r) for r in found.collect()] == [(1, [3, 2])]
    bases = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "line int, base string")
    assert [tuple(r) for r in lint.repeated_bases(bases).collect()] == [("a", 2)]


@pytest.mark.parametrize("digits", [1, 4])
def test_samples_are_the_first_in_the_shuffled_order(spark, monkeypatch, digits):
    monkeypatch.setattr(cov, "_PASS_DIGITS", digits)
    frame = spark.range(700).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS key")
    order = {i: hashlib.md5(f"7/{i}".encode()).hexdigest() for i in range(700)}
    for n in (0, 1, 57, 699, 700, 5000):
        found = [r["id"] for r in cov.sample_requests(frame, n, 7, F.col("id")).collect()]
        assert sorted(found) == sorted(sorted(order, key=order.get)[:n])
    # A third of the rows has one key; equal rows count each.
    for n in (1, 200, 500):
        by_key = cov.sample_requests(frame, n, 7, F.col("key"))
        assert by_key.count() == n and sorted(map(tuple, by_key.collect())) == sorted(map(tuple, by_key.collect()))
    same = spark.range(90).selectExpr("1 AS id")
    assert cov.sample_requests(same, 40, 7, F.col("id")).count() == 40
