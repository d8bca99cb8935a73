"""Conversation structure repair by iterative-deepening A*.

A conversation is in order when its role initials read ``(s?(ua)+)?`` and it holds no blank, duplicate or truncated
row. Keeping a row costs 0 (3 if it is truncated), giving it the role user or assistant 3 more, deleting it 4, and
inserting an empty row 3; blank and duplicate rows must go. A depth-first search takes the edits in ASCII order (D, I,
K, R) under a cost bound that rises to the least cost beyond it. What a failed search learns, the least cost from a row
and state on, is kept in a transposition table, so no state fails twice with the same bound. Bounds never exceed the
true cost, so the first accepted path is the cheapest one, and the least in ASCII order among equals.

Long conversations are searched in segments from the last to the first, from every state at which a segment can be
entered, with the costs of what follows as costs of its exits. Rows meet by ranges of (conversation, turn), so one
conversation may spread over many tasks; what comes together of a conversation is a byte for each of its rows, no more
than its audit string has. Its texts pass once, sorted, through a task that holds one batch at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsight.llm.groups import with_groups
from tabsight.sources.files import discard, materialised

SEGMENT = 32

# fixed values: white space, sentence ends, and the costs of edits
SPACES = "\x20\x09\x0A\x0B\x0C\x0D"
SENTENCE_ENDS = (".", "!", "?")
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3

# A code is the role's class (s, u, a, other) plus four times the fault (none, blank, duplicate, truncated).
_KINDS = "sua"
_BLANK, _DUPLICATE, _CUT = 1, 2, 3
# States: nothing yet, after s, after u, after a. _KEEP: by state, the classes that may follow, and the state then.
_KEEP = ({0: 1, 1: 2}, {1: 2}, {2: 3}, {1: 2})
_NEXT = (2, 2, 3, 2)
#: Cost of ending in a state, and the rows that must still be inserted.
_ENDS = (0, 2 * INSERT, INSERT, 0)
_LEGAL = ((0, 1), (1, 2), (2, 1))


@lru_cache(maxsize=20_000)
def _segment(codes: bytes, exits: tuple[int, ...]) -> tuple[tuple[int, str, int], ...]:
    """(cost, edits, exit state) of the best path through the rows from each of the four states.

    ``exits`` are the costs from the state behind the last row on.
    """
    n = len(codes)
    rest = [0] * (n + 1)  # what each row costs at least, from here on
    for r in range(n - 1, -1, -1):
        kind, fault = codes[r] % 4, codes[r] // 4
        own = DELETE if fault in (_BLANK, _DUPLICATE) else min(DELETE, (REROLE if kind == 3 else 0) + (TRUNCATED if fault == _CUT else 0))
        rest[r] = rest[r + 1] + own
    end = min(exits)
    known = [[x + end] * 4 for x in rest]  # the transposition table: least costs from (row, state) on
    known[n] = list(exits)

    def go(r: int, state: int, left: int) -> tuple[str, int] | None:
        if r == n:
            return "", state
        kind, fault = codes[r] % 4, codes[r] // 4
        moves = [("D", r + 1, state, DELETE), ("I", r, _NEXT[state], INSERT)]
        if fault not in (_BLANK, _DUPLICATE):
            extra = TRUNCATED if fault == _CUT else 0
            if kind in _KEEP[state]:
                moves.append(("K", r + 1, _KEEP[state][kind], extra))
            moves.append(("R", r + 1, _NEXT[state], REROLE + extra))
        least = None
        for edit, row, then, cost in moves:
            if cost + known[row][then] <= left:
                found = go(row, then, left - cost)
                if found:
                    return edit + found[0], found[1]
            beyond = cost + known[row][then]
            least = beyond if least is None else min(least, beyond)
        known[r][state] = max(known[r][state], least)
        return None

    out = []
    for state in range(4):
        while True:
            bound = known[0][state]
            found = go(0, state, bound)
            if found:
                out.append((bound, *found))
                break
    return tuple(out)


def cheapest_edits(codes: bytes, segment: int = SEGMENT) -> tuple[int, str]:
    """Cost and edits of the cheapest repair of rows given by their codes."""
    ahead = _ENDS
    steps = []
    for at in range((len(codes) - 1) // segment * segment, -1, -segment):
        base = min(ahead)
        found = _segment(codes[at: at + segment], tuple(x - base for x in ahead))
        steps.append([(edits, then) for _, edits, then in found])
        ahead = tuple(base + cost for cost, _, _ in found)
    state, audit = 0, []
    for step in reversed(steps):
        edits, state = step[state]
        audit.append(edits)
    return ahead[0], "".join(audit) + "I" * (_ENDS[state] // INSERT)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with rows dropped, emptied, cut, repeated or given a wrong role, by a checksum.

    Null roles and texts become one space, as null ids and turns are in the checksum; the ids and turns stay null.
    """
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    case, text = F.crc32(key) % 20, F.coalesce("text", blank)
    rows = conversations.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), text.alias("text"), case.alias("case")).filter("case <> 0")
    text = F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("case") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("case") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def _rows(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(id, turn, role, text, key): null roles and texts are one space; the key stands for role and text."""
    role, text = F.coalesce(F.col(role_col), F.lit(" ")), F.coalesce(F.col(text_col), F.lit(" "))
    key = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    return conversations.select(F.col(id_col).alias("id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"), key.alias("key"))


def _order() -> list[Column]:
    return [F.col("id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("key").asc()]


def edits(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
          text_col: str = "text") -> DataFrame:
    """(id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation that has rows.

    Rows are taken by turn, nulls first, and rows of one turn by a digest of role and text, so that equal ones are
    adjacent. A row's first fault counts: blank (white space only), duplicate (an earlier row has its role and
    text), truncated (no sentence end last). ``illegal`` counts adjacent role initials other than su, ua and au.
    ``gaps`` are turns that are missing between the first and the last. Null roles and texts are one space, null ids
    one conversation; an empty table gives no rows. Other columns are not read.
    """
    rows = _rows(conversations, id_col, turn_col, role_col, text_col)
    body = F.rtrim("text", F.lit(SPACES))
    kind = F.expr(f"instr('{_KINDS}', substring(role, 1, 1))") - 1  # 0 for an empty role, too
    narrow = materialised(rows.select(
        "id", "turn", "key", F.when((kind >= 0) & (F.length("role") > 0), kind).otherwise(3).alias("kind"), (F.length(body) == 0).alias("blank"),
        (~F.substring(body, -1, 1).isin(*SENTENCE_ENDS)).alias("cut")))
    place = F.struct(F.col("turn").isNotNull(), F.coalesce("turn", F.lit(0).cast("long")))
    known = with_groups(narrow, ["id", "key"], [F.min(place).alias("first")]).withColumn("later", place > F.col("first"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The codes of each conversation's rows in this task: one row for each, or more where batches end."""
        part, piece, before = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            turns, keys = batch.column("turn").to_pylist(), batch.column("key").to_pylist()
            ids = batch.column("id").to_pylist()
            kinds, blank, cut, later = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "blank", "cut", "later"))
            same = np.zeros(len(ids), bool)
            for k, this in enumerate(zip(ids, turns, keys, strict=True)):
                same[k] = this == before
                before = this
            codes = (kinds + 4 * np.select([blank, later | same, cut], [_BLANK, _DUPLICATE, _CUT], 0)).astype(np.uint8)
            heads = [k for k in range(len(ids)) if not k or ids[k] != ids[k - 1]]
            raw = codes.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(heads, pa.int64())), pa.array([part] * len(heads), pa.int64()), pa.array(range(piece, piece + len(heads)), pa.int64()),
                 pa.array([raw[a:b] for a, b in zip(heads, [*heads[1:], len(ids)], strict=True)], pa.binary())], ["id", "part", "piece", "codes"])
            piece += len(heads)

    id_type = narrow.schema["id"].dataType.simpleString()
    dealt = known.repartitionByRange(*_order()).sortWithinPartitions(*_order())
    pieces = dealt.mapInArrow(gather, f"id {id_type}, part long, piece long, codes binary")
    whole = pieces.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("part", "piece", "codes"))).alias("pieces"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for own in batch.column("pieces"):
                codes = b"".join(x["codes"] for x in own.as_py())
                each = np.frombuffer(codes, np.uint8)
                faults, kinds = np.bincount(each // 4, minlength=4), each % 4
                legal = sum(int(((kinds[:-1] == a) & (kinds[1:] == b)).sum()) for a, b in _LEGAL)
                found.append((*faults[[_BLANK, _DUPLICATE, _CUT]].tolist(), len(each) - 1 - legal, *cheapest_edits(codes)))
            columns = list(zip(*found, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.string())],
                                             ["id", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    solved = whole.mapInArrow(solve, f"id {id_type}, blank long, duplicate long, truncated long, illegal long, cost long, audit string")
    turns = narrow.groupBy("id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps")).withColumnRenamed("id", "turns_of")
    out = materialised(solved.join(turns, F.col("id").eqNullSafe(F.col("turns_of"))).select(
        F.col("id").alias(id_col), F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit"))
    discard(narrow)
    return out


def repaired(conversations: DataFrame, found: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
             text_col: str = "text") -> DataFrame:
    """(id, place, edit, role, text): the rows of the repaired conversations, in order within each task.

    ``found`` are the ``edits`` of the same rows. A conversation's edits go first, its rows follow in their order.
    """
    rows = _rows(conversations, id_col, turn_col, role_col, text_col).withColumn("kind", F.lit(1))
    lead = found.select(F.col(id_col).alias("id"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"),
                        F.lit("").alias("key"), F.lit(0).alias("kind"))
    order = [F.col("id").asc_nulls_first(), F.col("kind"), F.col("turn").asc_nulls_first(), F.col("key")]
    dealt = rows.unionByName(lead).repartition("id").sortWithinPartitions(*order)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, state, place = "", 0, 0, 0
        for batch in batches:
            out: list[tuple] = []

            def inserted(k: int) -> None:
                nonlocal at, state, place
                while at < len(audit) and audit[at] == "I":
                    state = _NEXT[state]
                    out.append((k, place, "I", "assistant" if state == 3 else "user", ""))
                    at, place = at + 1, place + 1

            kinds, roles, texts = (batch.column(c).to_pylist() for c in ("kind", "role", "text"))
            for k in range(batch.num_rows):
                if not kinds[k]:
                    audit, at, state, place = texts[k], 0, 0, 0
                    inserted(k)
                    continue
                edit, role = audit[at], roles[k]
                at += 1
                if edit != "D":
                    state = _NEXT[state] if edit == "R" else _KEEP[state][_KINDS.index(role[0])]
                    role = ("assistant" if state == 3 else "user") if edit == "R" else role
                    out.append((k, place, edit, role, texts[k]))
                    place += 1
                inserted(k)
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.string()) for c in columns[2:])],
                ["id", "place", "edit", "role", "text"])

    id_type = dealt.schema["id"].dataType.simpleString()
    return dealt.mapInArrow(apply, f"id {id_type}, place long, edit string, role string, text string").withColumnRenamed("id", id_col)


def digests(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, repaired_sha256) of conversations whose rows stand in order within a task, as ``repaired`` leaves them."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, this, sha = None, None, None

        def done(ids: list, shas: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(shas, pa.string())], [id_col, "repaired_sha256"])

        for batch in batches:
            kind, ids, shas = batch.schema.field(0).type, [], []
            for own, place, role, text in zip(*(batch.column(c).to_pylist() for c in (0, "place", "role", "text")), strict=True):
                if not place:
                    if sha:
                        ids.append(this)
                        shas.append(sha.hexdigest())
                    this, sha = own, hashlib.sha256()
                sha.update((("\n" if place else "") + f"{role}:{text}").encode())
            if ids:
                yield done(ids, shas)
        if sha:
            yield done([this], [sha.hexdigest()])

    id_type = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, "place", "role", "text").mapInArrow(digest, f"`{id_col}` {id_type}, repaired_sha256 string")
