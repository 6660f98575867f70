"""Weak credential parts: which are free of strong forms."""

from __future__ import annotations

from titleloom.llm import secrets

TEXT = "https://10.0.0.5:9200/?token=abcdef123456XY\npassword: hunter2"


def test_each_weak_part_is_tested_on_its_own():
    base = secrets.base_spans(TEXT)
    assert [TEXT[b:u] for b, _, u in base] == ["token=abcdef123456XY"]
    assert secrets.weak_spans(TEXT, base) == [(8, 5, 21), (44, 4, 61)]


def test_address_inside_an_url_links_the_password(spark):
    rows = spark.createDataFrame([(1, TEXT)], "doc_id long, text string")
    found = secrets.scan_secrets(rows).first()["spans"]
    assert (4, 44, 61) in [(s["kind"], s["begin"], s["until"]) for s in found]


def test_parts_exactly_at_reach_are_linked(spark):
    """With a reach of 200 bins are 400 wide: the endpoint ends at a border, the password's range begins there."""
    rows = [(1, 5, 390, 400, 0), (1, 4, 600, 610, 0), (2, 5, 390, 399, 0), (2, 4, 600, 610, 0)]
    parts = spark.createDataFrame(rows, "row_id long, kind int, begin long, until long, scope int")
    assert {(r["row_id"], r["kind"]) for r in secrets.link_parts(parts, 200).collect()} == {(1, 5), (1, 4)}


def test_scopes_end_at_blank_lines_of_any_kind(spark):
    host, password = "host: db.example.org", "password: hunter2"
    breaks = ["\n", "\r\n", "\n# a comment of some length" * 20 + "\n", "\n\n", "\r\n\r\n", "\n \t \n", "\r\r", "\n\n\n\n"]
    rows = spark.createDataFrame([(i, host + b + password) for i, b in enumerate(breaks)], "doc_id long, text string")
    linked = {r["doc_id"]: len(r["spans"]) for r in secrets.scan_secrets(rows).collect()}
    assert linked == {i: 2 if i < 3 else 0 for i in range(len(breaks))}


def test_endpoints_are_addresses_and_stand_once():
    def kinds(text):
        return [(text[b:u], kind) for b, kind, u in secrets.weak_spans(text, secrets.base_spans(text))]

    assert kinds("version 1.2.3.4 password: hunter2") == [("password: hunter2", 4)]
    assert kinds("at 300.1.1.1:80 and 10.0.0.5:80") == [("10.0.0.5:80", 5)]
    assert [kind for _, kind in kinds("endpoint=https://10.0.0.5/x")] == [5]


def test_scope_links_equal_brute_force(spark):
    """Random parts: each weak one is held against all parts of its scope."""
    import random

    draw = random.Random(5)
    rows = {(draw.randrange(40), draw.randrange(6), 10 * k, 10 * k + 5, draw.randrange(3)) for k in range(300)}
    parts = spark.createDataFrame(sorted(rows), "row_id long, kind int, begin long, until long, scope int")
    found = {tuple(r) for r in secrets.link_parts(parts).collect()}
    wants = {3: {0, 2, 4}, 5: {0, 2, 4}, 4: {1, 3, 5}}
    assert found == {
        (i, k, b, u) for i, k, b, u, s in rows
        if k >= 3 and any(o[0] == i and o[4] == s and o[1] in wants[k] for o in rows)
    }
