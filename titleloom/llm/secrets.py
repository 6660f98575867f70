"""Credentials in texts: strong forms by pattern, weak parts where their counterparts stand nearby."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titleloom.llm.common import staged

# Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "weak_access", "weak_secret", "endpoint")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ASSIGN_LENGTH = 12
# A match of fewer characters fails, and none of its tails can be long enough.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}", re.ASCII)
HEX = re.compile(r"[0-9a-f]{16,}", re.ASCII)
# Parts that say little alone. An assigned one is a name before a colon or equals sign and a value behind it.
ASSIGNING = re.compile(r"[:=]")
NAME_CHARS = 64
ACCESS_NAME = re.compile(r"""(?:access|account|client|tenant|user)[_-]?(?:id|key_?id|name)["']?\x20{0,8}$""", re.ASCII | re.I)
SECRET_NAME = re.compile(r"""(?:password|passwd|secret|token|api_?key|pwd|auth)["']?\x20{0,8}$""", re.ASCII | re.I)
ENDPOINT_NAME = re.compile(r"""(?:host|endpoint|server)["']?\x20{0,8}$""", re.ASCII | re.I)
VALUE = re.compile(r"""\x20{0,8}["']?[A-Za-z0-9+/_.:@=-]{4,}""", re.ASCII)
NAMES = ((ACCESS_NAME, 3), (SECRET_NAME, 4), (ENDPOINT_NAME, 5))
# Bare ones: identifiers of capitals and digits, mixed tokens around a digit, addresses.
CAPITALS = re.compile(r"[A-Z0-9]{16,}", re.ASCII)
DIGITS = re.compile(r"[0-9]+", re.ASCII)
TOKEN = re.compile(r"[A-Za-z0-9+/_-]+", re.ASCII)
TOKEN_LENGTH = 20
URL = re.compile(r"""https?://[^\s"'<>]{4,}""", re.ASCII)
# With a port or a path behind it; without one, four numbers may be a version.
ADDRESS = re.compile(r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5}(?![0-9.])|(?=/))", re.ASCII)
# One or more lines of nothing but white space, with any line ends.
SCOPE_BREAK = re.compile(r"(?:\n|\r(?!\n))\s*[\r\n]")
SPAN = "struct<kind:int,begin:long,until:long,scope:int>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(begin, kind, until)`` of the strong forms, leftmost and without overlap per kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_LENGTH]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _assigned(text: str) -> Iterator[tuple[int, int, int]]:
    for sign in ASSIGNING.finditer(text):
        begin = max(0, sign.start() - NAME_CHARS)
        before = text[begin : sign.start()]
        for name, kind in NAMES:
            if key := name.search(before):
                if value := VALUE.match(text, sign.end()):
                    yield begin + key.start(), kind, value.end()
                break


def _bare(text: str) -> Iterator[tuple[int, int, int]]:
    for m in CAPITALS.finditer(text):
        run = m.group()
        if run[:2].isalpha() and not run.isalpha() and not text[m.end() : m.end() + 1].islower():
            yield m.start(), 3, m.end()
    seen = 0
    for m in DIGITS.finditer(text):
        if m.start() < seen:
            continue
        # Digits between letters and token signs belong to one run; a run is looked at once.
        run_begin = m.start()
        while run_begin > seen and TOKEN.match(text[run_begin - 1]):
            run_begin -= 1
        seen = TOKEN.match(text, run_begin).end()
        run = text[run_begin:seen]
        if len(run) >= TOKEN_LENGTH and run.upper() != run and run.lower() != run:
            yield run_begin, 4, seen
    if "://" in text:
        for m in URL.finditer(text):
            yield m.start(), 5, m.end()
    for m in ADDRESS.finditer(text):
        octets = m.group().partition(":")[0].split(".")
        if not (m.start() and text[m.start() - 1] in "0123456789.") and all(int(x) < 256 for x in octets):
            yield m.start(), 5, m.end()


def weak_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The weak parts of a text that overlap no strong form; of those of a kind that overlap, the leftmost, then longest."""
    taken = sorted((b, u) for b, _, u in base)
    begins = [b for b, _ in taken]
    # The furthest end of the strong forms that begin before a place.
    ends = [-1, *accumulate((u for _, u in taken), max)]
    found = sorted({*_assigned(text), *_bare(text)}, key=lambda span: (span[0], span[1], -span[2]))
    kept, until = [], {}
    for b, kind, u in found:
        if b >= ends[bisect_left(begins, u)] and b >= until.get(kind, 0):
            kept.append((b, kind, u))
            until[kind] = u
    return kept


def _find(batches: Iterator) -> Iterator:
    import pyarrow as pa

    kind = pa.list_(pa.struct([("kind", pa.int32()), ("begin", pa.int64()), ("until", pa.int64()), ("scope", pa.int32())]))
    for batch in batches:
        spans = []
        for value in batch.column("text"):
            text = value.as_py() or ""
            base = base_spans(text)
            both = sorted(base + weak_spans(text, base))
            breaks = [m.start() for m in SCOPE_BREAK.finditer(text)] if both else []
            spans.append(
                [{"kind": k, "begin": b, "until": u, "scope": bisect_left(breaks, b)} for b, k, u in both]
            )
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])


def _bins(parts: DataFrame, left: Column, right: Column, width: int) -> DataFrame:
    first, last = F.floor(left / width), F.floor(right / width)
    return parts.withColumn("bin", F.explode(F.sequence(first, last)))


def link_parts(parts: DataFrame, reach: int | None = None) -> DataFrame:
    """The weak parts (``row_id, kind, begin, until``) that have their counterpart in the same scope.

    An access identifier and an endpoint need a secret (weak, assigned or hexadecimal), a weak secret needs an access
    identifier (weak or strong) or an endpoint. A scope is the interval that both must lie in: per scope it is
    counted once which parts occur, and each weak part meets that one row, so no pairs arise.

    With ``reach``, at most so many code points may lie between the two as well. The interval join is then an equality
    join on bins of the text: a part stands in the bins that it covers or ends at, its counterpart's search range in
    all that it touches. A bin holds few parts as they do not overlap within a kind, and a semi join returns each
    part once.
    """
    secret, access, endpoint = F.col("kind").isin(0, 2, 4), F.col("kind").isin(1, 3), F.col("kind") == 5
    if reach is None:
        scopes = parts.groupBy(F.col("row_id").alias("o_row"), F.col("scope").alias("o_scope")).agg(
            F.max(secret).alias("secret"), F.max(access | endpoint).alias("target")
        )
        counterpart = F.when(F.col("kind") == 4, F.col("target")).otherwise(F.col("secret"))
        inside = (F.col("row_id") == F.col("o_row")) & (F.col("scope") == F.col("o_scope")) & counterpart
        return parts.filter("kind >= 3").join(scopes, inside, "left_semi").select("row_id", "kind", "begin", "until")
    width = 2 * reach
    weak = _bins(parts.filter("kind >= 3"), F.greatest(F.col("begin") - reach, F.lit(0)), F.col("until") + reach, width)
    wanted = weak.withColumn("wants", F.explode(F.when(F.col("kind") == 4, F.array(F.lit(1), F.lit(2))).otherwise(
        F.array(F.lit(0)))))
    offered = _bins(parts, F.col("begin"), F.col("until"), width).select(
        F.col("row_id").alias("o_row"),
        F.col("scope").alias("o_scope"),
        F.col("bin").alias("o_bin"),
        F.col("begin").alias("o_begin"),
        F.col("until").alias("o_until"),
        F.when(secret, F.lit(0)).when(access, F.lit(1)).when(endpoint, F.lit(2)).alias("offers"),
    )
    near = (
        (F.col("row_id") == F.col("o_row"))
        & (F.col("scope") == F.col("o_scope"))
        & (F.col("bin") == F.col("o_bin"))
        & (F.col("wants") == F.col("offers"))
        & (F.col("o_begin") <= F.col("until") + reach)
        & (F.col("begin") <= F.col("o_until") + reach)
    )
    linked = wanted.join(offered, near, "left_semi")
    return linked.select("row_id", "kind", "begin", "until").distinct()


def scan_secrets(docs: DataFrame, reach: int | None = None) -> DataFrame:
    """``doc_id, spans``: per row of ``docs`` the strong spans and the linked weak ones, sorted by begin, then kind.

    A span is ``(kind, begin, until)`` in code points, the end exclusive; ``kind`` indexes ``KINDS``. A null or
    empty text has none. Rows are told apart by a number of their own, so repeated doc_ids and null ones are no
    matter; extra columns are not read. Scopes are the parts of a text between lines without anything but white space;
    parts are linked inside one scope at any distance, or with at most ``reach`` code points between them.
    """
    found = staged(
        docs.select("doc_id", "text")
        .mapInArrow(_find, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans array<{SPAN}>")
        .withColumn("row_id", F.monotonically_increasing_id()),
        "spans",
    )
    parts = found.filter(F.size("spans") > 0).select("row_id", F.inline("spans"))
    linked = link_parts(parts, reach).groupBy("row_id").agg(
        F.collect_list(F.struct("begin", "kind", "until")).alias("weak")
    )
    strong = F.transform(
        F.filter("spans", lambda s: s["kind"] < 3),
        lambda s: F.struct(s["begin"].alias("begin"), s["kind"].alias("kind"), s["until"].alias("until")),
    )
    joined = found.join(linked, "row_id", "left")
    every = F.when(F.col("weak").isNull(), strong).otherwise(F.sort_array(F.concat(strong, F.col("weak"))))
    return joined.select("doc_id", F.sort_array(every).alias("spans"))


def span_text(spans: Column) -> Column:
    """``kind:begin:until``, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["begin"].cast("string"), s["until"].cast("string")),
        ),
        ",",
    )
