"""Cheapest repair of a conversation's structure by Knuth's lightest derivations."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Hashable, Iterable, Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from geostat_spark.llm.text import SPACE, WORD
from geostat_spark.operators.attach import attach_counted
from geostat_spark.session import cut

Weight = tuple[int, str]  # cost, then the edits' letters: smaller is lighter
Item = Hashable

# The costs of the edits and of a cut-off row that stays.
REROLE, DELETE, INSERT, LEFT_CUT = 1, 2, 5, 5

# What may come next: the grammar is an optional system row, then pairs of user and assistant, or nothing at all.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ROLES = {"u": "user", "a": "assistant"}
GOALS = (START, ASSISTANT)
FAULTS = ("blank", "duplicate", "truncated")
ROWS_APART = 512  # rows of one conversation that are repaired in one piece


def lightest(
    axioms: Iterable[tuple[Item, Weight]], deduce: Callable[[Item], Iterable[tuple[Item, int, str]]], goal: Callable[[Item], bool] | None = None
) -> dict[Item, Weight]:
    """The lightest weight of every item popped, until ``goal`` holds for one or, without it, of all items.

    ``deduce(item)`` gives (item, cost, letters) for each deduction with ``item`` as its one antecedent that is
    not an axiom. Its weight function adds the cost and appends the letters: it never gives less than the
    antecedent's weight and keeps its order, so the first weight an item is popped with is its lightest."""
    agenda: list[tuple[Weight, Item]] = []
    for item, weight in axioms:
        heappush(agenda, (weight, item))
    done: dict[Item, Weight] = {}
    while agenda:
        weight, item = heappop(agenda)
        if item in done:
            continue
        done[item] = weight
        if goal and goal(item):
            break
        for other, cost, letters in deduce(item):
            if other not in done:
                heappush(agenda, ((weight[0] + cost, weight[1] + letters), other))
    return done


Row = tuple[str, str, str]  # role, text, fault or ""


def _edits(rows: list[Row]) -> Callable[[Item], list[tuple[Item, int, str]]]:
    """Deductions over items (rows read, state)."""

    def deduce(item: tuple[int, int]) -> list[tuple[Item, int, str]]:
        read, state = item
        out = [((read, after), INSERT, "I") for role, after in NEXT[state].items() if role != "s"]
        if read < len(rows):
            role, _, fault = rows[read]
            out.append(((read + 1, state), DELETE, "D"))
            if fault not in ("blank", "duplicate"):
                more = LEFT_CUT if fault == "truncated" else 0
                for to, after in NEXT[state].items():
                    if role[:1] == to:
                        out.append(((read + 1, after), more, "K"))
                    if to != "s":
                        out.append(((read + 1, after), more + REROLE, "R"))
        return out

    return deduce


def repair(rows: list[Row], begin: int = START) -> dict[int, Weight]:
    """The lightest (cost, edits) for each state that the rows can end in from ``begin``."""
    done = lightest([((0, begin), (0, ""))], _edits(rows))
    return {state: weight for (read, state), weight in done.items() if read == len(rows)}


def repair_whole(rows: list[Row]) -> Weight:
    """The lightest (cost, edits) of a whole conversation."""
    n = len(rows)
    done = lightest([((0, START), (0, ""))], _edits(rows), lambda item: item[0] == n and item[1] in GOALS)
    return next(reversed(done.values()))


def repaired_lines(rows: list[Row], edits: str, begin: int = START) -> list[str]:
    """The lines ``role:text`` that the edits leave; the grammar names the role of a row put in or given another."""
    out, state, at = [], begin, 0
    for edit in edits:
        role, text, _ = rows[at] if edit != "I" else ("", "", "")
        at += edit != "I"
        if edit == "D":
            continue
        if edit == "K":
            state = NEXT[state][role[:1]]
        else:
            letter = next(r for r in NEXT[state] if r != "s")
            role, state = ROLES[letter], NEXT[state][letter]
        out.append(f"{role}:{text}")
    return out


PIECES = (
    "part int, seq int, whole boolean, first_turn long, last_turn long, turns long, first_role string, last_role string, "
    "blank long, duplicate long, truncated long, illegal long, steps array<struct<from:int,to:int,cost:long,edits:string>>, "
    "rows array<struct<role:string,text:string,fault:string>>, cost long, audit string, repaired_sha256 string"
)
_STEP = pa.struct([("from", pa.int32()), ("to", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())])
_ROW = pa.struct([(c, pa.string()) for c in ("role", "text", "fault")])
_KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def _piece_schema(conv: pa.DataType) -> pa.Schema:
    fields = [("key", pa.string()), ("conv", conv)]
    for field in PIECES.split(", "):
        name, kind = field.split(" ")
        fields.append((name, pa.list_(_STEP) if name == "steps" else pa.list_(_ROW) if name == "rows" else _KINDS[kind]))
    return pa.schema(fields)


class _Piece:
    """Consecutive rows of one conversation, and what they say of it."""

    def __init__(self, key: str, conv: object):
        self.key, self.conv = key, conv
        self.rows: list[Row] = []
        self.turns, self.first_turn, self.last_turn = 0, None, None
        self.faults = dict.fromkeys(FAULTS, 0)
        self.illegal, self.before = 0, None
        self.size = 0

    def add(self, turn: int | None, role: str, text: str, fault: str) -> None:
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        if self.rows and self.rows[-1][0][:1] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        if fault:
            self.faults[fault] += 1
        self.rows.append((role, text, fault))
        self.size += len(text)

    def record(self, part: int, seq: int, whole: bool) -> dict:
        out = {
            "key": self.key, "conv": self.conv, "part": part, "seq": seq, "whole": whole,
            "first_turn": self.first_turn, "last_turn": self.last_turn, "turns": self.turns,
            "first_role": self.rows[0][0][:1], "last_role": self.rows[-1][0][:1], **self.faults, "illegal": self.illegal,
            "steps": None, "rows": None, "cost": None, "audit": None, "repaired_sha256": None,
        }
        if whole:
            out["cost"], out["audit"] = repair_whole(self.rows)
            lines = "\n".join(repaired_lines(self.rows, out["audit"]))
            out["repaired_sha256"] = hashlib.sha256(lines.encode("utf-8", "surrogatepass")).hexdigest()
        else:
            out["steps"] = [
                {"from": a, "to": b, "cost": cost, "edits": edits}
                for a in NEXT
                for b, (cost, edits) in repair(self.rows, a).items()
            ]
            out["rows"] = [dict(zip(("role", "text", "fault"), r)) for r in self.rows]
        return out


def _pieces(ordered: DataFrame, rows_apart: int) -> DataFrame:
    """A record for each conversation, or for each piece of one that reaches over a partition's end or is long.

    ``ordered``: sorted over all partitions by key and order of rows."""
    kind = ordered.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        schema, out, seq = None, [], 0
        piece: _Piece | None = None
        edge, last = True, None  # the first conversation of a partition may have begun in the one before

        def close(whole: bool) -> None:
            nonlocal seq
            out.append(piece.record(part, seq, whole))
            seq += 1

        for batch in batches:
            schema = schema or _piece_schema(batch.schema.field("conv").type)
            for key, conv, turn, role, digest, text, fault in zip(*[batch.column(c).to_pylist() for c in ("key", "conv", "turn", "role", "digest", "text", "fault")]):
                if piece is not None and piece.key != key:
                    close(not edge)
                    piece, edge, last = None, False, None
                elif piece is not None and (len(piece.rows) >= rows_apart or piece.size > 1 << 22):
                    close(False)
                    piece, edge = _Piece(key, conv), True
                piece = piece or _Piece(key, conv)
                again = last == (turn, role, digest)
                last = (turn, role, digest)
                piece.add(turn, role, text, "duplicate" if again and fault != "blank" else fault)
            if len(out) >= 1_000:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if piece is not None:
            close(False)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return ordered.mapInArrow(run, f"key string, conv {kind}, {PIECES}")


def _chain(pieces: DataFrame) -> DataFrame:
    """(key, conv, part, seq, begin, edits, the conversation's numbers): the path through the pieces of each long
    conversation. Items (pieces read, state) are derived from an item before and one of the piece's steps."""
    kind = pieces.schema["conv"].dataType.simpleString()
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = f"key string, conv {kind}, part int, seq int, begin int, edits string, {', '.join(n + ' long' for n in numbers)}"
    narrow = pieces.select("key", "conv", "part", "seq", "first_turn", "last_turn", "turns", "first_role", "last_role", *FAULTS, "illegal", "steps")

    def solve(own: list[dict]) -> list[dict]:
        steps = [{} for _ in own]
        for by_state, piece in zip(steps, own):
            for s in piece["steps"]:
                by_state.setdefault(s["from"], []).append((s["to"], s["cost"], s["edits"]))

        def deduce(item: tuple[int, int]) -> list[tuple[Item, int, str]]:
            read, state = item
            return [((read + 1, to), cost, edits) for to, cost, edits in steps[read].get(state, ())] if read < len(own) else []

        done = lightest([((0, START), (0, ""))], deduce, lambda item: item[0] == len(own) and item[1] in GOALS)
        item, weight = next(reversed(done.items()))
        path = []
        while item[0]:  # back along the weights
            read, state = item
            for a, found in steps[read - 1].items():
                before = done.get((read - 1, a))
                edits = next((e for to, cost, e in found if to == state and before and (before[0] + cost, before[1] + e) == weight), None)
                if edits is not None:
                    path.append((read - 1, a, edits))
                    item, weight = (read - 1, a), before
                    break
        total = {f: sum(p[f] for p in own) for f in (*FAULTS, "illegal", "turns")}
        low, high, last = None, None, None
        for p, q in zip(own, own[1:]):
            total["illegal"] += p["last_role"] + q["first_role"] not in ("su", "ua", "au")
        for p in own:
            if p["turns"]:
                total["turns"] -= p["first_turn"] == last
                low, high, last = p["first_turn"] if low is None else low, p["last_turn"], p["last_turn"]
        total["gaps"] = high - low + 1 - total["turns"] if low is not None else 0
        total["cost"] = done[(len(own), START)][0] if (len(own), START) in done and (len(own), ASSISTANT) not in done else done[(len(own), ASSISTANT)][0]
        return [
            {"key": own[k]["key"], "conv": own[k]["conv"], "part": own[k]["part"], "seq": own[k]["seq"], "begin": a, "edits": e, **{n: total[n] for n in numbers}}
            for k, a, e in reversed(path)
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[dict] = []
        shape = None
        for batch in batches:
            shape = shape or pa.schema(
                [("key", pa.string()), ("conv", batch.schema.field("conv").type), ("part", pa.int32()), ("seq", pa.int32()), ("begin", pa.int32()), ("edits", pa.string())]
                + [(n, pa.int64()) for n in numbers]
            )
            for record in batch.to_pylist():
                if own and own[0]["key"] != record["key"]:
                    yield pa.RecordBatch.from_pylist(solve(own), schema=shape)
                    own = []
                own.append(record)
        if own:
            yield pa.RecordBatch.from_pylist(solve(own), schema=shape)

    return narrow.repartition("key").sortWithinPartitions("key", "part", "seq").mapInArrow(run, schema)


def _joined_lines(paths: DataFrame, pieces: DataFrame) -> DataFrame:
    """(key, part, seq, edits, lines): the repaired text of each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for begin, edits, rows in zip(*[batch.column(c).to_pylist() for c in ("begin", "edits", "rows")]):
                lines = repaired_lines([(r["role"], r["text"], r["fault"]) for r in rows], edits, begin)
                texts.append("\n".join(lines) if lines else None)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("key", "part", "seq", "edits")], pa.array(texts, pa.string())], names=["key", "part", "seq", "edits", "lines"])

    met = paths.join(pieces.select("key", "part", "seq", "rows"), ["key", "part", "seq"])
    return met.select("key", "part", "seq", "edits", "begin", "rows").mapInArrow(run, "key string, part int, seq int, edits string, lines string")


def _digests(lines: DataFrame) -> DataFrame:
    """(key, audit, repaired_sha256): pieces in order through one running digest; a piece is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, audit, begun = None, None, [], False
        shape = pa.schema([(c, pa.string()) for c in ("key", "audit", "repaired_sha256")])

        def answer() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"key": key, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}], schema=shape)

        for batch in batches:
            for own, edits, text in zip(*[batch.column(c).to_pylist() for c in ("key", "edits", "lines")]):
                if sha is None or own != key:
                    if sha is not None:
                        yield answer()
                    key, sha, audit, begun = own, hashlib.sha256(), [], False
                audit.append(edits)
                if text is not None:
                    sha.update((("\n" if begun else "") + text).encode("utf-8", "surrogatepass"))
                    begun = True
        if sha is not None:
            yield answer()

    return lines.repartition("key").sortWithinPartitions("key", "part", "seq").mapInArrow(run, "key string, audit string, repaired_sha256 string")


RESULT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repair_conversations(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", rows_apart: int = ROWS_APART
) -> DataFrame:
    """One row per conversation: its id, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``,
    ``audit``, ``repaired_sha256``.

    The rows of a conversation stand by turn, nulls first; rows of one turn by role, then by the SHA-256 of the
    text. Null roles and texts count as one space. A null conversation id is a conversation. Rows that repeat turn,
    role and text are duplicates but for one. A role is read by its first letter; one that is none of s, u and a
    can be given another or be deleted only. Other columns are ignored. No rows give no rows.

    Rows are sorted over all partitions, so a conversation may lie in several: it is repaired in pieces of at most
    ``rows_apart`` rows, each from every state it can begin in, and the pieces' lightest repairs are the axioms of
    a second derivation. As no two repairs of the same rows and states with one cost begin alike, pieces put
    together are as light as the whole. A long conversation's letters, and its text piece by piece, pass one task
    at the end: one value of the result holds the letters, and SHA-256 reads the text in order."""
    own = rows.select(
        F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("")).alias("key"),
        F.col(conv).alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"),
    ).withColumn("digest", F.sha2("text", 256))
    kept = cut(own)
    firsts = kept.groupBy("key", "role", "digest").agg(
        F.max(F.col("turn").isNull()).alias("unplaced"), F.min("turn").alias("first"), F.count(F.lit(1)).alias("n")
    )
    told = attach_counted(kept, firsts.where("n > 1"), ["key", "role", "digest"], "n", "turn", kept.count())
    later = F.col("turn").isNotNull() & (F.col("unplaced") | (F.col("turn") > F.col("first")))
    ends = F.regexp_extract("text", f"({WORD[:-1]}){SPACE}*$", 1)
    fault = (
        F.when(~F.col("text").rlike(WORD), "blank")
        .when(later, "duplicate")
        .when(~ends.isin(".", "!", "?"), "truncated")
        .otherwise("")
    )
    ordered = told.withColumn("fault", fault).select("key", "conv", "turn", "role", "digest", "text", "fault")
    ordered = ordered.orderBy("key", F.col("turn").asc_nulls_first(), "role", "digest")
    pieces = cut(_pieces(ordered, rows_apart))
    split = pieces.where(~F.col("whole"))
    paths = cut(_chain(split))
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    long_ = paths.groupBy("key").agg(F.first("conv").alias("conv"), *[F.first(n).alias(n) for n in numbers])
    long_ = long_.join(_digests(_joined_lines(paths, split)), "key").select("conv", *RESULT)
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    whole = pieces.where("whole").select("conv", gaps, *[c for c in RESULT if c != "gaps"])
    return whole.unionByName(long_).withColumnRenamed("conv", conv)
