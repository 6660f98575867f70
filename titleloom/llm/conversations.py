"""Repair of conversation structure: cheapest edits of long role sequences by a Viterbi search in parallel chunks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titleloom.llm.common import staged

# Rows and characters of a chunk: what a task holds of a conversation at once.
CHUNK_ROWS = 2048
CHUNK_CHARS = 1 << 18
BLANKS = " \t\n\x0b\x0c\r"
INITIALS = "sua"
LEGAL = {"su", "ua", "au"}
# Faults of a row.
SOUND, TRUNCATED, BLANK, DUPLICATE = range(4)
# States: nothing yet, behind a system row, behind a user row, behind an assistant row. Roles are s?(ua)+ or nothing, so
# each state has one state that an inserted or renamed row leads to.
OPEN, SYSTEM, USER, ASSISTANT = range(4)
NEEDED = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
# State behind a kept row, by state and initial (s, u, a, other).
KEPT = ((SYSTEM, USER, -1, -1), (-1, USER, -1, -1), (-1, -1, ASSISTANT, -1), (-1, USER, -1, -1))
DELETE, INSERT, RENAME, CUT_SHORT = 3, 2, 2, 1
# Costs from each state behind the last row: rows to insert until the roles may end.
FINAL = bytes((0, 2 * INSERT, INSERT, 0))


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, present``: rows damaged by CRC-32 of ``conv_id:turn``, a null taken as one space.

    Of 20 remainders 0 drops the row (``present`` is false), 1 empties its text, 2 removes its ``.!?``, 3 gives it
    twice, 4 sets its role to user. Extra columns are not read.
    """

    def held(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fate = F.crc32(F.concat(held("conv_id"), F.lit(":"), held("turn")).cast("binary")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(held("text"), "[.!?]", "")).otherwise(held("text"))
    return conversations.select(
        "conv_id", "turn", F.when(fate == 4, "user").otherwise(held("role")).alias("role"), text.alias("text"),
        (fate != 0).alias("present"), F.explode(F.array_repeat(F.lit(0), F.when(fate == 3, 2).otherwise(1))).alias("__copy"),
    ).drop("__copy")


class Search:
    """Steps of the search over one row, computed once per cost vector and kind of row.

    A kind is ``4 * initial + fault``. A cost vector holds, for each state, the least cost to the end above the least of
    all states. Such differences are small, so there are few vectors.
    """

    def __init__(self):
        self.steps: dict[tuple[bytes, int], tuple[bytes, int]] = {}
        self.moves: dict[tuple[bytes, int, int], tuple[int, str, int]] = {}

    def before(self, behind: bytes, kind: int) -> tuple[bytes, int]:
        """The vector before a row of this kind, from the one behind it, and what all its costs have in common."""
        found = self.steps.get((behind, kind))
        if found is None:
            costs = self._costs(behind, kind)
            least = min(costs)
            found = self.steps[behind, kind] = bytes(c - least for c in costs), least
        return found

    @staticmethod
    def _edits(behind: bytes, kind: int, state: int) -> list[tuple[int, str, int]]:
        """Cost, letter and next state of each edit of the row itself, by letter."""
        initial, fault = divmod(kind, 4)
        edits = [(DELETE + behind[state], "D", state)]
        if fault in (SOUND, TRUNCATED):
            extra = CUT_SHORT if fault == TRUNCATED else 0
            kept, needed = KEPT[state][initial], NEEDED[state]
            if kept >= 0:
                edits.append((extra + behind[kept], "K", kept))
            edits.append((extra + RENAME + behind[needed], "R", needed))
        return edits

    def _costs(self, behind: bytes, kind: int) -> list[int]:
        costs = [min(cost for cost, _, _ in self._edits(behind, kind, state)) for state in range(4)]
        for _ in range(3):
            costs = [min(cost, INSERT + costs[NEEDED[state]]) for state, cost in enumerate(costs)]
        return costs

    def move(self, behind: bytes, kind: int, state: int) -> tuple[int, str, int]:
        """Rows to insert before a row, its letter and the state behind it: of the cheapest edits those with least letters."""
        found = self.moves.get((behind, kind, state))
        if found is None:
            costs, inserted, at = self._costs(behind, kind), 0, state
            while True:
                best = [(letter, after) for cost, letter, after in self._edits(behind, kind, at) if cost == costs[at]]
                if best and best[0][0] == "D" or costs[at] != INSERT + costs[NEEDED[at]]:
                    break
                inserted, at = inserted + 1, NEEDED[at]
            found = self.moves[behind, kind, state] = inserted, *best[0]
        return found

    def backward(self, kinds: bytes, end: bytes, old: tuple[bytes, bytes] | None = None):
        """Start vector, cost in common, vectors (four bytes a row) and steps (one byte a row) of a chunk with this end.

        With the vectors and steps of an earlier pass it stops where the vectors differ only by a constant, that is
        where they are equal: all before stays as it was.
        """
        vectors, steps, vector, total = [], [], end, 0
        for at in range(len(kinds) - 1, -1, -1):
            vector, step = self.before(vector, kinds[at])
            vectors.append(vector)
            steps.append(step)
            total += step
            if old is not None and old[0][4 * at : 4 * at + 4] == vector:
                kept = old[1][:at]
                return (old[0][:4] if at else vector), total + sum(kept), old[0][: 4 * at] + b"".join(vectors[::-1]), kept + bytes(steps[::-1])
        return vector, total, b"".join(vectors[::-1]), bytes(steps[::-1])

    def forward(self, kinds: bytes, vectors: bytes, end: bytes, state: int) -> tuple[list[tuple[int, str, int]], int]:
        """The move of each row and the state behind the last, from a state before the first."""
        moves = []
        behind = [vectors[i : i + 4] for i in range(4, len(vectors), 4)]
        behind.append(end)
        for kind, vector in zip(kinds, behind, strict=False):
            move = self.move(vector, kind, state)
            moves.append(move)
            state = move[2]
        return moves, state


def repaired_rows(moves, state: int, roles, texts, kinds: bytes, first: int, last: bool):
    """Letters, roles and texts of a chunk after its moves; behind the last chunk rows are inserted until roles may end."""
    letters, new_roles, new_texts, at = [], [], [], first

    def insert() -> int:
        letters.append("I")
        new_roles.append(ROLE[NEEDED[at]])
        new_texts.append("")
        return NEEDED[at]

    for (inserted, letter, after), role, text in zip(moves, roles, texts, strict=True):
        for _ in range(inserted):
            at = insert()
        letters.append(letter)
        if letter != "D":
            new_roles.append(role if letter == "K" else ROLE[after])
            new_texts.append(text)
        at = after
    while last and FINAL[at]:
        at = insert()
    return "".join(letters), new_roles, new_texts


def row_kinds(roles: list[str], texts: list[str]) -> tuple[bytes, dict[tuple[str, str], int]]:
    """The kind of each row as far as these rows tell, and the first row of each role and text that is not blank."""
    kinds, seen = bytearray(), {}
    for at, (role, text) in enumerate(zip(roles, texts, strict=True)):
        initial = INITIALS.find(role[0]) if role else -1
        core = text.rstrip(BLANKS)
        if not core:
            fault = BLANK
        elif (role, text) in seen:
            fault = DUPLICATE
        else:
            seen[role, text] = at
            fault = SOUND if core[-1] in ".!?" else TRUNCATED
        kinds.append(4 * (initial if initial >= 0 else 3) + fault)
    return bytes(kinds), seen


def _name(row: tuple[str, str]) -> bytes:
    """128 bits that tell roles and texts apart."""
    import hashlib

    role, text = (value.encode("utf-8", "surrogatepass") for value in row)
    return hashlib.blake2b(b"%d:%b%b" % (len(role), role, text), digest_size=16).digest()


def _batch(columns: dict, found: list):
    """A record batch of rows as tuples; ``columns`` names their Arrow types."""
    import pyarrow as pa

    values = list(zip(*found, strict=True)) or [()] * len(columns)
    arrays = [pa.array(v, kind) for v, kind in zip(values, columns.values(), strict=True)]
    return pa.RecordBatch.from_arrays(arrays, list(columns))


def cut_chunks(rows: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Conversations in order, cut into chunks: one row each, numbered by ``part, number``, with their rows as arrays.

    Rows are dealt by range over conversation and turn, so a long conversation lies in several tasks. ``whole`` says that
    a chunk is all of its conversation: it is neither cut nor at the edge of a task's range. Rows stand by turn (null
    first), then by role and text (of long ones by their starts first). Rows equal in all may stand in any order. ``kinds``
    are those that the chunk alone tells; for the rows of an open chunk that are the first of their role and text in it,
    ``keys`` and ``key_rows`` allow to look for earlier ones in other chunks.
    """
    order = [F.col("conv_id"), F.col("turn"), F.substring("role", 1, 64), F.substring("text", 1, 64), F.col("role"), F.col("text")]
    # Equal rows are told apart by where they were read, so that any number of them can be dealt out.
    dealt = rows.withColumn("__place", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(*order[:4], F.col("__place")).sortWithinPartitions(*order, "__place")
    kind = rows.schema["conv_id"].dataType.simpleString()

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        columns = {
            "conv_id": None, "part": pa.int32(), "number": pa.int64(), "whole": pa.bool_(), "turns": pa.list_(pa.int64()),
            "roles": pa.list_(pa.string()), "texts": pa.list_(pa.string()), "kinds": pa.binary(),
            "keys": pa.list_(pa.binary()), "key_rows": pa.list_(pa.int32()),
        }
        out: list[tuple] = []
        turns, roles, texts, chars, cut = [], [], [], 0, False
        number, conversations, written = 0, 0, 0
        name = unset = object()

        def close(whole: bool) -> None:
            nonlocal turns, roles, texts, chars, number, written
            kinds, seen = row_kinds(roles, texts)
            keys = ([], []) if whole else ([_name(row) for row in seen], list(seen.values()))
            out.append((name, part, number, whole, turns, roles, texts, kinds, *keys))
            written += chars
            turns, roles, texts, chars, number = [], [], [], 0, number + 1

        for batch in batches:
            columns["conv_id"] = batch.schema.field("conv_id").type
            held = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "present")]
            for conv_id, turn, role, text, present in zip(*held, strict=True):
                if name is unset or conv_id != name:
                    if name is not unset:
                        close(conversations > 1 and not cut)
                    name, cut, conversations = conv_id, False, conversations + 1
                if not present:
                    continue
                if len(roles) >= chunk_rows or (roles and chars + len(text) > chunk_chars):
                    cut = True
                    close(False)
                turns.append(turn)
                roles.append(role)
                texts.append(text)
                chars += len(text)
                if written >= 1 << 23:
                    yield _batch(columns, out)
                    out, written = [], 0
        if name is not unset:
            close(False)
        if out:
            yield _batch(columns, out)

    return dealt.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", "present").mapInArrow(
        work,
        f"conv_id {kind}, part int, number long, whole boolean, turns array<long>, roles array<string>, "
        "texts array<string>, kinds binary, keys array<binary>, key_rows array<int>",
    )


def _mapped(rows: DataFrame, answer, kinds: str, *kept: str) -> DataFrame:
    """``kept`` columns of each row and what ``answer(search, row)`` returns for it, as columns of ``kinds``."""
    fields = [f for f in rows.schema if f.name in kept]
    names = [f.name for f in fields]
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)
    new = rows.sparkSession.createDataFrame([], kinds).schema

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        search = Search()
        for batch in batches:
            found = [answer(search, row) for row in batch.to_pylist()]
            values = list(zip(*found, strict=True)) or [()] * len(new)
            arrays = [pa.array(v, to_arrow_type(f.dataType)) for v, f in zip(values, new, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *arrays], [*names, *new.names])

    return rows.mapInArrow(work, types + kinds)


def _with_earlier_duplicates(chunks: DataFrame) -> DataFrame:
    """Open chunks with their final ``kinds``: rows whose role and text stand in an earlier chunk are duplicates too.

    A chunk offers each role and text once, so a group has at most as many rows as its conversation has chunks.
    """
    entries = chunks.select("conv_id", "part", "number", F.explode(F.arrays_zip("keys", "key_rows")).alias("e"))
    earlier = F.row_number().over(Window.partitionBy("conv_id", "e.keys").orderBy("part", "number")) > 1
    later = (
        entries.withColumn("later", earlier).filter("later").groupBy("part", "number")
        .agg(F.collect_list("e.key_rows").alias("repeats"))
    )

    def mark(search: Search, row: dict) -> tuple:
        kinds = bytearray(row["kinds"])
        for at in row["repeats"] or ():
            kinds[at] = kinds[at] // 4 * 4 + DUPLICATE
        return (bytes(kinds),)

    joined = chunks.select("conv_id", "part", "number", "kinds").join(later, ["part", "number"], "left")
    return _mapped(joined, mark, "kinds binary", "conv_id", "part", "number")


PASS = "end binary, start binary, total long, vectors binary, steps binary"


def converged(chunks: DataFrame) -> DataFrame:
    """Open chunks (``conv_id, part, number, kinds``) with the cost vectors of the search from the end of their conversation.

    All chunks start at once, as if each were the last one. In the passes that follow a chunk takes the start vector of
    the next one as its end, if that is not what it had, and goes back only as far as its vectors change by more than a
    constant. Passes end when every chunk has the start vector of the next: after few, since the vectors before a
    chunk hardly depend on those behind it.
    """

    def speculate(search: Search, row: dict) -> tuple:
        start, total, vectors, steps = search.backward(row["kinds"], FINAL)
        return FINAL, start, total, vectors, steps

    def repeat(search: Search, row: dict) -> tuple:
        if row["wanted"] is None:
            return tuple(row[c] for c in ("end", "start", "total", "vectors", "steps"))
        start, total, vectors, steps = search.backward(row["kinds"], row["wanted"], (row["vectors"], row["steps"]))
        return row["wanted"], start, total, vectors, steps

    names = ("conv_id", "part", "number", "kinds")
    state = staged(_mapped(chunks, speculate, PASS, *names), "speculated")
    following = F.lead("start").over(Window.partitionBy("conv_id").orderBy("part", "number"))
    while True:
        wanted = state.select("conv_id", "part", "number", "end", "start").select(
            "part", "number", "end", F.coalesce(following, F.lit(FINAL)).alias("wanted")
        )
        stale = staged(wanted.filter("end != wanted").select("part", "number", "wanted"), "stale")
        if stale.isEmpty():
            return state
        state = staged(_mapped(state.join(stale, ["part", "number"], "left"), repeat, PASS, *names), "repeated")


def _streamed(rows: DataFrame, answer, kinds: str) -> DataFrame:
    """``answer(rows)`` over the open chunks of each task, conversation by conversation in order; none is held whole."""
    placed = rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", "number")
    new = rows.sparkSession.createDataFrame([], kinds).schema

    def work(batches: Iterator) -> Iterator:
        from pyspark.sql.pandas.types import to_arrow_type

        columns = {f.name: to_arrow_type(f.dataType) for f in new}
        found, held = [], 0
        for answered in answer(row for batch in batches for row in _rows_of(batch)):
            found.append(answered)
            held += sum(len(v) for v in answered if isinstance(v, str))
            if len(found) >= 10_000 or held >= 1 << 23:
                yield _batch(columns, found)
                found, held = [], 0
        if found:
            yield _batch(columns, found)

    return placed.mapInArrow(work, kinds)


def _rows_of(batch) -> Iterator[dict]:
    for at in range(batch.num_rows):
        yield {name: batch.column(i)[at].as_py() for i, name in enumerate(batch.schema.names)}


def _with_first_state(state: DataFrame) -> DataFrame:
    """``part, number, first``: the state that each open chunk starts in.

    Each chunk is traced from all four states on its own; per conversation these four results are then composed.
    """

    def outcomes(search: Search, row: dict) -> tuple:
        ends = bytes(search.forward(row["kinds"], row["vectors"], row["end"], s)[1] for s in range(4))
        return (ends,)

    def compose(rows: Iterator[dict]) -> Iterator[tuple]:
        name = object()
        at = OPEN
        for row in rows:
            if row["conv_id"] != name:
                name, at = row["conv_id"], OPEN
            yield row["part"], row["number"], at
            at = row["ends"][at]

    ends = _mapped(state, outcomes, "ends binary", "conv_id", "part", "number")
    return _streamed(ends, compose, "part int, number long, first int")


PIECE = (
    "audit string, repaired array<struct<role:string,text:string>>, cost long, first_turn long, last_turn long, "
    "turns_seen long, rows_seen long, blank long, duplicate long, truncated long, illegal long, initials string"
)


def _piece(search: Search, row: dict, kinds: bytes, vectors: bytes, end: bytes, cost: int, first: int, last: bool) -> tuple:
    moves, state = search.forward(kinds, vectors, end, first)
    letters, roles, texts = repaired_rows(moves, state, row["roles"], row["texts"], kinds, first, last)
    turns = [t for t in row["turns"] if t is not None]
    initials = "".join(INITIALS[k // 4] if k < 12 else "?" for k in kinds)
    faults = [k % 4 for k in kinds]
    return (
        letters, [{"role": r, "text": t} for r, t in zip(roles, texts, strict=True)], cost,
        turns[0] if turns else None, turns[-1] if turns else None, len(set(turns)), len(kinds),
        faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED),
        sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)),
        initials[:1] + initials[-1:],
    )


def repair_conversations(rows: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Repaired conversations, a long one in several pieces: ``conv_id, part, number, whole, last`` and the columns of ``PIECE``.

    ``rows`` has ``conv_id, turn, role, text`` and ``present`` (a conversation with no present row gives an empty
    piece). A row's first fault counts: blank, duplicate of an earlier role and text, truncated (its last character that is
    not blank is none of ``.!?``). Blank and duplicate rows are deleted (3). Rows are kept (0), renamed to user or
    assistant (2) or deleted, empty ones inserted (2), a truncated row that stays costs 1, so that the initials of the
    roles are ``s?(ua)+`` or nothing at the least cost. ``audit`` names the edits (``K R D I``), the least string of the
    cheapest. Null roles and texts are one space, null conv_ids are one conversation, turns may repeat or be
    null. ``part, number`` give the order of pieces. Extra columns are not read.
    """
    held = rows.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        F.coalesce("present", F.lit(True)).alias("present"),
    )
    chunks = staged(cut_chunks(held, chunk_rows, chunk_chars), "chunks")

    def at_once(search: Search, row: dict) -> tuple:
        start, total, vectors, _ = search.backward(row["kinds"], FINAL)
        return True, *_piece(search, row, row["kinds"], vectors, FINAL, total + start[OPEN], OPEN, True)

    def in_place(search: Search, row: dict) -> tuple:
        cost = row["total"] + (row["start"][OPEN] if row["opens"] else 0)
        return row["last"], *_piece(search, row, row["kinds"], row["vectors"], row["end"], cost, row["first"], row["last"])

    names = ("conv_id", "part", "number", "whole")
    whole = _mapped(chunks.filter("whole").drop("keys", "key_rows"), at_once, f"last boolean, {PIECE}", *names)
    rest = chunks.filter("not whole")
    state = converged(_with_earlier_duplicates(rest))
    first = _with_first_state(state).toDF("p", "n", "first")
    in_order = Window.partitionBy("conv_id").orderBy("part", "number")
    edges = state.select("conv_id", "part", "number").select(
        F.col("part").alias("q"), F.col("number").alias("m"), F.lag("part").over(in_order).isNull().alias("opens"),
        F.lead("part").over(in_order).isNull().alias("last"),
    )
    found = state.drop("conv_id", "steps").withColumnsRenamed({"part": "a", "number": "b"})
    found = found.join(first, (F.col("a") == F.col("p")) & (F.col("b") == F.col("n")))
    found = found.join(edges, (F.col("a") == F.col("q")) & (F.col("b") == F.col("m")))
    joined = rest.drop("kinds", "keys", "key_rows").join(found, (F.col("part") == F.col("a")) & (F.col("number") == F.col("b")))
    open_pieces = _mapped(joined, in_place, f"last boolean, {PIECE}", *names)
    return whole.unionByName(open_pieces)


SUMMARY = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


def summarize(pieces: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id`` and the columns of ``SUMMARY``, from the pieces of ``repair_conversations``.

    ``gaps`` counts the turns that lack between the first and the last one. Pieces of one conversation are read in order
    and hashed one by one, so that no task holds more than a piece and the audit.
    """
    lines = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    lined = pieces.withColumn("kept", F.size("repaired").cast("long")).withColumn("repaired", lines)
    gaps = F.when(F.col("turns_seen") == 0, 0).otherwise(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns_seen"))
    whole = lined.filter("whole").select(
        "conv_id", gaps.cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.sha2(F.col("repaired").cast("binary"), 256).alias("repaired_sha256"),
    )
    kind = pieces.schema["conv_id"].dataType.simpleString()

    def stitch(rows: Iterator[dict]) -> Iterator[tuple]:
        import hashlib

        counted = ("blank", "duplicate", "truncated", "illegal", "cost")
        fresh = True
        for row in rows:
            if fresh:
                sums, audit, digest, lines = dict.fromkeys(counted, 0), [], hashlib.sha256(), 0
                low = high = None
                seen, before, fresh = 0, "", False
            for name in counted:
                sums[name] += row[name]
            audit.append(row["audit"])
            if row["kept"]:
                digest.update(("\n" if lines else "").encode() + row["repaired"].encode("utf-8", "surrogatepass"))
                lines += row["kept"]
            if row["initials"]:
                sums["illegal"] += bool(before) and before + row["initials"][0] not in LEGAL
                before = row["initials"][-1]
            if row["turns_seen"]:
                seen += row["turns_seen"] - (high == row["first_turn"])
                low, high = row["first_turn"] if low is None else low, row["last_turn"]
            if row["last"]:
                lacking = high - low + 1 - seen if seen else 0
                yield row["conv_id"], lacking, *sums.values(), "".join(audit), digest.hexdigest()
                fresh = True

    parts = lined.filter("not whole").drop("whole")
    return whole.unionByName(_streamed(parts, stitch, f"conv_id {kind}, {SUMMARY}"))
