"""Conversation structure repair: cheapest edits by A* on the edit lattice.

A conversation is well formed if the initials of its roles read
``(s?(ua)+)?``.  A node of the lattice is (rows consumed, state of that
grammar); an edge keeps, re-roles or deletes the next row or inserts an empty
turn.  The heuristic is the suffix sum of what no edit can avoid: deletions of
blank and repeated rows, one for every truncated row.  The queue is keyed by
(cost + heuristic, audit), so the first arrival has the least cost and, of
these, the least audit.

Rows are range-sorted by conversation and turn and cut into pieces of bounded
size.  A piece that holds a whole conversation is solved where it lies.  Pieces
of conversations that cross a range, or are longer than a piece, are summed up
as transfers (entry state to exit state); two scans over these small rows, one
forwards and one backwards, tell each piece its entry and its exit.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import ASCII_SPACE, store

PIECE_ROWS, PIECE_BYTES = 1000, 4 << 20
COST = {"K": 0, "R": 2, "D": 3, "I": 2}
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a.
KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The role that re-roling and inserting give in a state, and the state after it.
GIVE = [("user", 2), ("user", 2), ("assistant", 3), ("user", 2)]
#: Inserts that complete the conversation from a state.
TAIL = ["", "II", "I", ""]
NEVER = 1 << 60
NO_TEXT = hashlib.sha256(b"").hexdigest()


def damage(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text) of the rows with faults by ``crc32("conv:turn") % 20``.

    0 drops the row, 1 empties its text, 2 removes ``.!?`` from it, 3 repeats
    the row, 4 sets its role to user.  A null id, turn, role or text counts as
    one space, the turn only within the checksum.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced(conv_col), F.lit(":"), spaced(turn_col))) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    base = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), spaced(role_col).alias("role"), spaced(text_col).alias("text"), kind.alias("kind"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    base = base.filter("kind <> 0").select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("_again"))
    return base.drop("_again")


@dataclass
class Code:
    """What the search needs of a row."""

    initial: str
    forced: bool
    truncated: bool


def faults(roles: list[str], texts: list[str], seen: set) -> list[str]:
    """The first fault of each row; ``seen`` holds the rows before and gains these."""
    out = []
    for row in zip(roles, texts):
        body = row[1].strip(ASCII_SPACE)
        out.append("blank" if not body else "duplicate" if row in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add(row)
    return out


def codes(roles: list[str], found: list[str]) -> list[Code]:
    return [Code(r[:1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(roles, found)]


def search(rows: list[Code], start: int, *, ends: bool, wanted: int | None = None) -> dict[int, tuple[int, str]]:
    """Exit state -> (cost, audit) of the cheapest edits of ``rows`` from state ``start``.

    With ``ends`` the conversation is completed behind the last row and only
    the best exit is given; without, every exit (or only the ``wanted`` one) as
    it is after the last row.
    """
    n = len(rows)
    rest = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        rest[i] = rest[i + 1] + (COST["D"] if rows[i].forced else rows[i].truncated)
    queue, done, found = [(rest[0], "", 0, start)], set(), {}
    while queue:
        total, audit, i, state = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n:
            if ends and state in (0, 3):
                return {state: (total, audit)}
            if not ends:
                found[state] = (total, audit)
                if state == wanted:
                    return {state: found[state]}
                continue
        cost, after = total - rest[i], GIVE[state][1]
        heapq.heappush(queue, (cost + COST["I"] + rest[i], f"{audit}I", i, after))
        if i == n:
            continue
        row, here = rows[i], rest[i + 1]
        heapq.heappush(queue, (cost + COST["D"] + here, f"{audit}D", i + 1, state))
        if not row.forced:
            cost += row.truncated
            heapq.heappush(queue, (cost + COST["R"] + here, f"{audit}R", i + 1, after))
            if (kept := KEEP.get((state, row.initial))) is not None:
                heapq.heappush(queue, (cost + here, f"{audit}K", i + 1, kept))
    return found


def apply(audit: str, roles: list[str], texts: list[str], start: int = 0) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the turns that the edits leave."""
    at, state = 0, start
    for edit in audit:
        if edit == "I":
            role, state = GIVE[state]
            yield edit, role, ""
            continue
        if edit == "K":
            state = KEEP[state, roles[at][:1]]
            yield edit, roles[at], texts[at]
        elif edit == "R":
            role, state = GIVE[state]
            yield edit, role, texts[at]
        at += 1


@dataclass
class Summary:
    """Counts and repaired text of a conversation whose pieces come in order."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    cost: int = 0
    turns: int = 0
    first: int | None = None
    last: int | None = None
    initial: str | None = None
    audit: list[str] = field(default_factory=list)
    digest: object = field(default_factory=hashlib.sha256)
    begun: bool = False

    def add(self, turns: list, roles: list[str], texts: list[str], found: list[str], start: int, audit: str, cost: int) -> None:
        self.blank += found.count("blank")
        self.duplicate += found.count("duplicate")
        self.truncated += found.count("truncated")
        for role in roles:
            if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.initial = role[:1]
        for turn in turns:
            if turn is not None and turn != self.last:
                self.turns += 1
                self.first = turn if self.first is None else self.first
                self.last = turn
        self.cost += cost
        self.audit.append(audit)
        for _, role, text in apply(audit, roles, texts, start):
            self.digest.update(f"{'\n' if self.begun else ''}{role}:{text}".encode())
            self.begun = True

    def row(self, conv) -> dict:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return {"conv": conv, "gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal,
                "cost": self.cost, "audit": "".join(self.audit), "repaired_sha256": self.digest.hexdigest()}


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _fields(conv: T.DataType, *more: str) -> T.StructType:
    return T.StructType([T.StructField("conv", conv), *T.StructType.fromDDL(", ".join(more)).fields])


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _mapped(df: DataFrame, rows, schema: T.StructType, size: int = 500) -> DataFrame:
    """``rows`` maps an iterator of row dicts to one; the output goes in batches of ``size``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, buffer = _arrow(schema), []
        for row in rows(r for batch in batches for r in batch.to_pylist()):
            buffer.append(row)
            if len(buffer) == size:
                yield pa.RecordBatch.from_pylist(buffer, arrow)
                buffer = []
        yield pa.RecordBatch.from_pylist(buffer, arrow)

    return df.mapInArrow(run, schema)


def cut(rows: DataFrame, piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(conv, piece, open, turns, roles, texts): the rows of each conversation in order, in pieces.

    Rows (conv, turn, role, text) are ordered by turn, nulls first; rows of one
    turn by role and then by SHA-256 of the text.  ``piece`` ascends in that
    order; a piece that is not ``open`` is a whole conversation.  A row's
    number is the last sort key, so that rows equal in all else can be dealt to
    several ranges.
    """
    marked = rows.withColumn("mark", F.sha2("text", 256)).withColumn("row", F.monotonically_increasing_id())
    order = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("mark"), F.asc("row")]
    schema = _fields(rows.schema["conv"].dataType, "piece long", "open boolean", "turns array<long>", "roles array<string>", "texts array<string>")

    def gather(found: Iterator[dict]) -> Iterator[dict]:
        base, number, held, size, first, begun = TaskContext.get().partitionId() << 32, 0, [], 0, True, False

        def piece(is_open: bool) -> dict:
            return {"conv": held[0]["conv"], "piece": base + number, "open": is_open, **{f"{c}s": [r[c] for r in held] for c in ("turn", "role", "text")}}

        for row in found:
            other = held and row["conv"] != held[0]["conv"]
            if held and (other or len(held) >= piece_rows or size >= piece_bytes):
                yield piece(first or begun or not other)
                first, begun = first and not other, not other
                number, held, size = number + 1, [], 0
            held.append(row)
            size += len(row["text"])
        if held:
            yield piece(True)

    ranged = marked.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", "role", "text")
    return _mapped(ranged, gather, schema, size=64)


def _solve_whole(found: Iterator[dict]) -> Iterator[dict]:
    for p in found:
        known = faults(p["roles"], p["texts"], set())
        ((cost, audit),) = search(codes(p["roles"], known), 0, ends=True).values()
        out = Summary()
        out.add(p["turns"], p["roles"], p["texts"], known, 0, audit, cost)
        yield out.row(p["conv"])


def _marks(found: Iterator[dict]) -> Iterator[dict]:
    """The first row of each (role, text) within a piece."""
    for p in found:
        seen = set()
        for at, row in enumerate(zip(p["roles"], p["texts"])):
            if row not in seen:
                seen.add(row)
                yield {"conv": p["conv"], "mark": hashlib.sha256(f"{len(row[0])}:{row[0]}{row[1]}".encode()).digest(), "piece": p["piece"], "at": at}


def _found(p: dict) -> list[str]:
    """Faults of a piece's rows, where ``seen`` lists the rows that an earlier piece has."""
    before = {(p["roles"][at], p["texts"][at]) for at in p["seen"] or ()}
    return faults(p["roles"], p["texts"], before)


def _transfers(found: Iterator[dict]) -> Iterator[dict]:
    """Costs from each entry to each exit, and the place of each exit's audit among its entry's."""
    for p in found:
        rows = codes(p["roles"], _found(p))
        costs, places = [], []
        for start in range(4):
            exits = search(rows, start, ends=False)
            ordered = sorted(exits, key=lambda x: exits[x][1])
            costs += [exits[x][0] if x in exits else NEVER for x in range(4)]
            places += [ordered.index(x) if x in exits else 4 for x in range(4)]
        yield {"conv": p["conv"], "piece": p["piece"], "costs": costs, "places": places}


def _forwards(found: Iterator[dict]) -> Iterator[dict]:
    """For each piece and exit the entry on the best way there, and the exit if the conversation ended here."""
    conv, best, rank = object(), [], []
    for p in found:
        if p["conv"] != conv:
            conv, best, rank = p["conv"], [0, NEVER, NEVER, NEVER], [0, 1, 2, 3]
        come = [min(range(4), key=lambda s: (best[s] + p["costs"][4 * s + x], rank[s])) for x in range(4)]
        order = sorted(range(4), key=lambda x: (rank[come[x]], p["places"][4 * come[x] + x]))
        best = [min(NEVER, best[come[x]] + p["costs"][4 * come[x] + x]) for x in range(4)]
        rank = [order.index(x) for x in range(4)]
        last = min(range(4), key=lambda x: (best[x] + COST["I"] * len(TAIL[x]), rank[x]))
        yield {"conv": conv, "piece": p["piece"], "come": come, "last": last}


def _backwards(found: Iterator[dict]) -> Iterator[dict]:
    """Entry and exit of each piece, from the last to the first."""
    conv, leave = object(), 0
    for p in found:
        ends = p["conv"] != conv
        leave = p["last"] if ends else leave
        conv, enter = p["conv"], p["come"][leave]
        yield {"piece": p["piece"], "enter": enter, "leave": leave, "ends": ends}
        leave = enter


def _chosen(p: dict, found: list[str]) -> tuple[int, str]:
    cost, audit = search(codes(p["roles"], found), p["enter"], ends=False, wanted=p["leave"])[p["leave"]]
    tail = TAIL[p["leave"]] if p["ends"] else ""
    return cost + COST["I"] * len(tail), audit + tail


def _joined(found: Iterator[dict]) -> Iterator[dict]:
    """Conversations from their pieces in order, one piece in memory at a time."""
    conv, out = None, None
    for p in found:
        if out is not None and p["conv"] != conv:
            yield out.row(conv)
            out = None
        conv, out = p["conv"], out or Summary()
        known = _found(p)
        cost, audit = _chosen(p, known)
        out.add(p["turns"], p["roles"], p["texts"], known, p["enter"], audit, cost)
    if out is not None:
        yield out.row(conv)


def _in_order(df: DataFrame, *order) -> DataFrame:
    return df.repartition("conv").sortWithinPartitions(F.asc_nulls_first("conv"), *order)


def planned(open_pieces: DataFrame) -> DataFrame:
    """The open pieces with ``seen``, ``enter``, ``leave`` and ``ends``."""
    kind = open_pieces.schema["conv"].dataType
    marks = store(_mapped(open_pieces, _marks, _fields(kind, "mark binary", "piece long", "at int"), 5000), "turn-marks")
    owner = marks.groupBy("conv", "mark").agg(F.min("piece").alias("own"))
    again = marks.join(owner.withColumnRenamed("conv", "c"), F.col("conv").eqNullSafe(F.col("c")) & (marks["mark"] == owner["mark"])).filter("piece > own")
    seen = again.groupBy("piece").agg(F.collect_list("at").alias("seen"))
    known = store(open_pieces.join(seen, "piece", "left"), "turn-pieces")
    each = _mapped(known, _transfers, _fields(kind, "piece long", "costs array<long>", "places array<int>"))
    there = _mapped(_in_order(each, "piece"), _forwards, _fields(kind, "piece long", "come array<int>", "last int"))
    back = _mapped(_in_order(there, F.desc("piece")), _backwards, T.StructType.fromDDL("piece long, enter int, leave int, ends boolean"))
    return known.join(back, "piece")


def repair(rows: DataFrame, *, piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """One row a conversation of rows (conv, turn, role, text): faults, cost, audit, digest of the repaired turns.

    Columns: conv, gaps (missing numbers between the least and the largest
    turn), blank, duplicate, truncated (rows by their first fault), illegal
    (neighbours whose role initials are not su, ua or au), cost, audit (edits'
    initials: Keep, Rerole, Delete, Insert), repaired_sha256 (``role:text``
    joined by newlines).

    A null id is a conversation of its own, null turns come first and count for
    no gap, rows of one turn are ordered by role and the text's SHA-256.  A
    null or empty role has no initial and is never kept as it is; a null text
    is blank.  An empty table gives no rows.  Beside SHA-256 and the audit,
    which are serial, nothing needs a conversation's rows in one task; these
    two read it as a stream, a piece at a time.
    """
    clean = rows.withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    pieces = store(cut(clean, piece_rows, piece_bytes), "conversations")
    schema = _fields(rows.schema["conv"].dataType, *(f"{c} long" for c in COUNTS), "audit string", "repaired_sha256 string")
    whole = _mapped(pieces.filter("not open"), _solve_whole, schema)
    return whole.unionByName(_mapped(_in_order(planned(pieces.filter("open")), "piece"), _joined, schema))


def repaired_turns(rows: DataFrame, *, piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(conv, piece, at, edit, role, text): the repaired turns, in the order of (piece, at) within a conversation."""
    clean = rows.withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    pieces = store(cut(clean, piece_rows, piece_bytes), "conversations")
    schema = _fields(rows.schema["conv"].dataType, "piece long", "at int", "edit string", "role string", "text string")

    def turns(found: Iterator[dict]) -> Iterator[dict]:
        for p in found:
            if "enter" in p:
                audit = _chosen(p, _found(p))[1]
            else:
                ((_, audit),) = search(codes(p["roles"], faults(p["roles"], p["texts"], set())), 0, ends=True).values()
            for at, (edit, role, text) in enumerate(apply(audit, p["roles"], p["texts"], p.get("enter", 0))):
                yield {"conv": p["conv"], "piece": p["piece"], "at": at, "edit": edit, "role": role, "text": text}

    return _mapped(pieces.filter("not open"), turns, schema).unionByName(_mapped(planned(pieces.filter("open")), turns, schema))


def damage_and_repair(convs: DataFrame, **names: str) -> DataFrame:
    """:func:`repair` of the damaged rows, with a row for every conversation of ``convs``.

    Conversations of which no row is left have zeros, an empty audit and the
    digest of no text.  Other columns of ``convs`` are not read.
    """
    conv = names.get("conv_col", "conv_id")
    every = convs.select(F.col(conv).alias("id")).distinct()
    found = every.join(repair(damage(convs, **names)), F.col("id").eqNullSafe(F.col("conv")), "left")
    zeros: list[Column] = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTS]
    return found.select(F.col("id").alias(conv), *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(NO_TEXT)).alias("repaired_sha256"))
