"""Repair of the structure of conversations as a lightest derivation.

A repaired conversation's roles read (s?(ua)+)?, by their initials. Its repair
is a derivation in a weighted hypergraph. Items are "the rows before i are
repaired and the grammar is in state q"; the axioms are the edits of each row and
the insertion of a turn; a deduction takes an item and an edit and concludes the
next item. The weight of a conclusion is the sum of its antecedents' costs and
the joined audit of their edits, compared in this order. That is monotone,
since no two audits of one item with one cost begin each other, and superior, as
an edit never makes a weight smaller. So Knuth's agenda may pop items by weight
and finalise each at its first pop, until the goal is popped.

Rows are range-partitioned by conversation and turn and cut into pieces of
bounded size, so a conversation may be longer than a task's memory. A piece of a
longer conversation gives its lightest derivations from each state to each
other one; turns are inserted before rows, never behind a piece's last one, so
a piece's audits do not begin each other and only their ranks go on: over the
ranks the same agenda puts the pieces together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from episodelake.llm.common import BROADCAST_ROWS, attach_groups, written

#: What an edit costs, and an undeleted truncated row besides.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States of the grammar: nothing yet, after system, after user, after assistant; the moves of each initial.
MOVES = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
STATES = range(4)
#: What ends a conversation in each state: the cheapest insertions behind its last row.
ENDS = {0: (0, ""), 1: (2 * INSERT, "II"), 2: (INSERT, "I"), 3: (0, "")}
LEGAL = {"su", "ua", "au"}
#: Rows and characters of a piece of a conversation; steps that one agenda holds.
PIECE_ROWS, PIECE_CHARS, CHUNK = 1024, 1 << 22, 512
BLANK, CUT = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"

Weight = tuple[int, str]
Edges = dict[tuple[int, int], Weight]
AT, EDIT, ADD, GOAL = range(4)
#: The axioms of insertion: (state, next state).
ADDED = [(q, q2) for initial in "ua" for q, q2 in MOVES[initial].items()]


# --- the agenda ------------------------------------------------------------


@lru_cache(maxsize=4096)
def row_edges(initial: str, delete: bool, truncated: bool, copies: int) -> Edges:
    """The lightest edit of a row, and of its further copies, between each two states."""
    edges: Edges = {(q, q): (DELETE * copies, "D" * copies) for q in STATES}
    if not delete:
        rest = (TRUNCATED * truncated + DELETE * (copies - 1), "D" * (copies - 1))
        for role in "sua":
            if role == initial or role != "s":
                cost, letter = (KEEP, "K") if role == initial else (REROLE, "R")
                edges |= {(q, q2): (cost + rest[0], letter + rest[1]) for q, q2 in MOVES[role].items()}
    return edges


def agenda(steps: list[Edges], start: int, insert: bool, ends: dict[int, Weight] | None) -> tuple[dict[int, Weight], Weight | None]:
    """(lightest weight of each state behind the last step, lightest weight of the goal) from a state; with ``ends`` it stops at the goal."""
    n = len(steps)
    heap = [((0, ""), (AT, 0, start, 0))]
    heap += [(w, (EDIT, i, q, q2)) for i, edges in enumerate(steps) for (q, q2), w in edges.items()]
    heap += [((INSERT, "I"), (ADD, 0, q, q2)) for q, q2 in ADDED] if insert else []
    heapify(heap)
    chart: dict[tuple, Weight] = {}
    edits: dict[tuple[int, int], list[int]] = {}  # finalised edits and insertions by their first antecedent's place and state
    adds: dict[int, list[int]] = {}
    reached: dict[int, list[int]] = {q: [] for q in STATES}  # finalised places by state

    def conclude(i: int, q: int, q2: int, axiom: Weight, to: int) -> None:
        cost, audit = chart[AT, i, q, 0]
        if (AT, to, q2, 0) not in chart:
            heappush(heap, ((cost + axiom[0], audit + axiom[1]), (AT, to, q2, 0)))

    while heap:
        weight, item = heappop(heap)
        if item in chart:
            continue
        chart[item] = weight
        kind, i, q, q2 = item
        if kind == AT:
            reached[q].append(i)
            for to in edits.get((i, q), []):
                conclude(i, q, to, chart[EDIT, i, q, to], i + 1)
            if i < n:
                for to in adds.get(q, []):
                    conclude(i, q, to, chart[ADD, 0, q, to], i)
            elif ends is not None:
                heappush(heap, ((weight[0] + ends[q][0], weight[1] + ends[q][1]), (GOAL, 0, 0, 0)))
        elif kind == EDIT:
            edits.setdefault((i, q), []).append(q2)
            if (AT, i, q, 0) in chart:
                conclude(i, q, q2, weight, i + 1)
        elif kind == ADD:
            adds.setdefault(q, []).append(q2)
            for at in reached[q]:
                if at < n:
                    conclude(at, q, q2, weight, at)
        else:
            break
    return {q: chart[AT, n, q, 0] for q in STATES if (AT, n, q, 0) in chart}, chart.get((GOAL, 0, 0, 0))


def ways(steps: list[Edges], insert: bool) -> Edges:
    """The lightest derivation over all steps between each two states."""
    return {(q, q2): w for q in STATES for q2, w in agenda(steps, q, insert, None)[0].items()}


def ranked(edges: Edges) -> Edges:
    """The same with one letter for each audit, in the order of the audits."""
    letters = {a: chr(65 + i) for i, a in enumerate(sorted({a for _, a in edges.values()}))}
    return {k: (cost, letters[a]) for k, (cost, a) in edges.items()}


def walked(steps: list[Edges], start: int, audit: str) -> list[tuple[int, int]]:
    """The states before and after each step along an audit of one letter a step."""
    out, q = [], start
    for edges, letter in zip(steps, audit, strict=False):
        q2 = next(to for (from_, to), (_, a) in edges.items() if from_ == q and a == letter)
        out.append((q, q2))
        q = q2
    return out


def route(steps: list[Edges]) -> list[tuple[int, int]]:
    """The states before and after each of the ranked steps in the lightest derivation from nothing to the goal."""
    if len(steps) <= CHUNK:
        return walked(steps, 0, agenda(steps, 0, False, ENDS)[1][1])
    chunks = [steps[a : a + CHUNK] for a in range(0, len(steps), CHUNK)]
    over = [ways(c, False) for c in chunks]
    return [pair for chunk, edges, way in zip(chunks, over, route([ranked(e) for e in over]), strict=True) for pair in walked(chunk, way[0], edges[way][1])]


@lru_cache(maxsize=1 << 14)
def repaired(rows: tuple) -> Weight:
    """Cost and audit of a whole conversation whose rows are (initial, delete, truncated, copies)."""
    steps = [row_edges(*r) for r in rows]
    return agenda(steps, 0, True, ENDS)[1]


def applied(rows: list[tuple[str, str, int]], audit: str, q: int) -> list[dict]:
    """The edits (edit, role, text) of an audit from a state; rows are (role, text, copies), deleted rows keep theirs."""
    out, at = [], (r[:2] for r in rows for _ in range(r[2]))
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(at)
        if letter in "IR":
            role = "assistant" if q == 2 else "user"
        if letter != "D":
            q = MOVES[role[0]][q]
        out.append({"edit": letter, "role": role, "text": text})
    return out


# --- Spark -----------------------------------------------------------------

EDITS = "array<struct<edit: string, role: string, text: string>>"
COUNTS = ["blank", "duplicate", "truncated", "illegal", "turns"]
STATS = ", ".join(f"{c} long" for c in COUNTS) + ", min_turn long, max_turn long, first_role string, last_role string"


def arrow_of(schema: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(schema))


def marked_rows(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text, copies, is_blank, repeats, cut): equal rows of one turn are one row; repeats says that role and text stand at an earlier turn.

    Rows whose role and text stand once in their conversation, nearly all, are
    neither grouped nor moved for it: only their digests are.
    """
    rows = df.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"))
    own = F.concat_ws(":", F.coalesce(F.col("conv").cast("string"), F.lit("")), F.col("conv").isNull().cast("string"), F.length("role").cast("string"), "role", "text")
    rows = rows.withColumn("key", F.unhex(F.sha2(own, 256)))
    groups = written(rows.groupBy("key").agg(F.min(F.struct(F.col("turn").isNotNull().alias("some"), "turn")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    n = groups.count()
    both = rows.join(F.broadcast(groups), "key", "left") if n <= BROADCAST_ROWS else attach_groups(rows, groups, "key", "n", rows.count())
    once = both.where("n is null").select("conv", "turn", "role", "text", "key", F.lit(1).cast("long").alias("copies"), F.lit(False).alias("repeats"))
    more = both.where("n is not null").groupBy("conv", "turn", "key").agg(F.first("role").alias("role"), F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"), F.first(~F.col("first.turn").eqNullSafe(F.col("turn"))).alias("repeats"))
    return once.unionByName(more).withColumns({"is_blank": ~F.col("text").rlike(BLANK), "cut": ~F.col("text").rlike(CUT)})


def cut_pieces(rows: DataFrame) -> DataFrame:
    """(conv, piece, whole, statistics, cost, ways, rows, edits): whole conversations with their edits, and pieces of those that may reach over a partition or piece.

    ``piece`` grows with the order of the rows; ways are (q, q2, cost, rank, audit).
    """
    kind = rows.schema["conv"].dataType.simpleString()
    ordered = rows.repartitionByRange("conv", "turn", "role", "key").sortWithinPartitions("conv", "turn", "role", "key").drop("key")
    schema = f"conv {kind}, piece long, whole boolean, {STATS}, cost long, ways array<struct<q: int, q2: int, cost: long, rank: int, audit: string>>, rows array<struct<role: string, text: string, copies: long>>, edits {EDITS}"

    arrow = arrow_of(schema)

    def statistics(rows: list[dict]) -> dict:
        first = [r["role"][:1] for r in rows]
        turns = [r["turn"] for r in rows if r["turn"] is not None]
        extra = [(r["copies"] - 1, r["is_blank"]) for r in rows]
        return {
            "blank": sum(r["copies"] for r in rows if r["is_blank"]),
            "duplicate": sum(r["repeats"] for r in rows if not r["is_blank"]) + sum(n for n, blank in extra if not blank),
            "truncated": sum(r["cut"] for r in rows if not r["is_blank"] and not r["repeats"]),
            "illegal": sum(a + b not in LEGAL for a, b in zip(first, first[1:], strict=False)) + sum(n for n, _ in extra),
            "turns": len({*turns}),
            "min_turn": min(turns, default=None), "max_turn": max(turns, default=None), "first_role": first[0], "last_role": first[-1],
        }

    def made(conv: object, piece: int, rows: list[dict], whole: bool) -> dict:
        shape = tuple((r["role"][:1], r["is_blank"] or r["repeats"], r["cut"], r["copies"]) for r in rows)
        texts = [(r["role"], r["text"], r["copies"]) for r in rows]
        out = {"conv": conv, "piece": piece, "whole": whole, **statistics(rows), "cost": None, "ways": None, "rows": None, "edits": None}
        if whole:
            cost, audit = repaired(shape)
            return out | {"cost": cost, "edits": applied(texts, audit, 0)}
        edges = ways([row_edges(*s) for s in shape], True)
        ranks = ranked(edges)
        return out | {"ways": [{"q": q, "q2": q2, "cost": w[0], "rank": ord(ranks[q, q2][1]) - 65, "audit": w[1]} for (q, q2), w in edges.items()], "rows": [dict(zip(("role", "text", "copies"), t, strict=True)) for t in texts]}

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[dict] = []
        out: list[dict] = []
        chars = size = done = 0  # characters held, characters in out, pieces of this conversation before
        seen = False  # whether another conversation came before

        def flush(whole: bool) -> None:
            nonlocal number, held, chars, size, done
            out.append(made(held[0]["conv"], number, held, whole))
            number, size, done = number + 1, size + chars, done + 1
            held, chars = [], 0

        for batch in batches:
            for row in batch.to_pylist():
                if held and row["conv"] != held[0]["conv"]:
                    flush(seen and not done)
                    seen, done = True, 0
                elif len(held) >= PIECE_ROWS or chars > PIECE_CHARS:
                    flush(False)
                held.append(row)
                chars += len(row["text"]) + 100
                if len(out) >= 4096 or size > 4 * PIECE_CHARS:
                    yield pa.RecordBatch.from_pylist(out, arrow)
                    out, size = [], 0
        if held:  # the last conversation may go on in the next partition
            flush(False)
            yield pa.RecordBatch.from_pylist(out, arrow)

    return ordered.mapInArrow(pieces, schema)


def joined_pieces(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv, statistics, cost) of conversations from their pieces, (piece, q, audit) for each piece): one small row of ways for each piece is brought together."""
    kind = pieces.schema["conv"].dataType.simpleString()
    slim = F.transform("ways", lambda w: F.struct(w["q"].alias("q"), w["q2"].alias("q2"), w["cost"].alias("cost"), w["rank"].alias("rank")))
    stats = [c.split()[0] for c in STATS.split(", ")]
    schema = f"conv {kind}, {STATS}, cost long, path array<struct<piece: long, q: int, q2: int, end: string>>"
    arrow = arrow_of(schema)
    together = pieces.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("piece", *stats, slim.alias("ways")))).alias("pieces"))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                parts = row["pieces"]
                steps = [{(w["q"], w["q2"]): (w["cost"], chr(65 + w["rank"])) for w in p["ways"]} for p in parts]
                path = route(steps)
                end = ENDS[path[-1][1]]
                sums = {c: sum(p[c] for p in parts) for c in COUNTS}
                sums["illegal"] += sum(a["last_role"] + b["first_role"] not in LEGAL for a, b in zip(parts, parts[1:], strict=False))
                # a turn that stands on both sides of a cut counts once
                last = None
                for p in parts:
                    sums["turns"] -= last is not None and p["min_turn"] == last
                    last = p["max_turn"] if p["max_turn"] is not None else last
                low, high = ([p[c] for p in parts if p[c] is not None] for c in ("min_turn", "max_turn"))
                cost = sum(s[way][0] for s, way in zip(steps, path, strict=True)) + end[0]
                ended = [""] * (len(parts) - 1) + [end[1]]
                ends = {"min_turn": min(low, default=None), "max_turn": max(high, default=None), "first_role": parts[0]["first_role"], "last_role": parts[-1]["last_role"]}
                steps_taken = [{"piece": p["piece"], "q": q, "q2": q2, "end": e} for p, (q, q2), e in zip(parts, path, ended, strict=True)]
                out.append({"conv": row["conv"], **sums, **ends, "cost": cost, "path": steps_taken})
            yield pa.RecordBatch.from_pylist(out, arrow)

    found = written(together.mapInArrow(chosen, schema))
    return found.drop("path"), found.select(F.explode("path").alias("p")).select("p.*")


def repair_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(pieces, report) of the cheapest repair of each conversation.

    ``pieces`` has conv, piece, whole and edits: an array of (edit, role, text)
    in order, K, R, D or I; a conversation's pieces follow each other by
    ``piece``, and whole says that there is one. ``report`` has one row a
    conversation: conv, gaps, blank, duplicate, truncated, illegal, cost.

    Rows are taken by turn, nulls first; rows of one turn by role and then by a
    digest of their content. A null role or text is one space, a null id is an
    id. A role counts by its first character; an empty one has none and is
    never kept. Blank rows and rows whose role and text stood before must go;
    a row that does not end in one of .!? costs 5 unless it goes. Equal costs
    are decided by the least audit. An empty table gives no rows; other columns
    are ignored. A conversation may be longer than a task's memory: pieces have
    PIECE_ROWS rows, and of each only its ways meet in one task.
    """
    pieces = written(cut_pieces(marked_rows(df, conv, turn, role, text)))
    rest = pieces.where("not whole")
    report, path = joined_pieces(rest)
    kept = rest.select("conv", "piece", "ways", "rows").join(path, "piece")
    schema = f"conv {pieces.schema['conv'].dataType.simpleString()}, piece long, edits {EDITS}"
    arrow = arrow_of(schema)

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):  # a piece at a time
                row = batch.slice(i, 1).to_pylist()[0]
                audit = next(w["audit"] for w in row["ways"] if (w["q"], w["q2"]) == (row["q"], row["q2"])) + row["end"]
                edits = applied([(r["role"], r["text"], r["copies"]) for r in row["rows"]], audit, row["q"])
                yield pa.RecordBatch.from_pylist([{"conv": row["conv"], "piece": row["piece"], "edits": edits}], arrow)

    columns = ["conv", "piece", "whole", "edits"]
    parts = pieces.where("whole").select(columns).unionByName(kept.mapInArrow(edited, schema).withColumn("whole", F.lit(False)).select(columns))
    gaps = F.coalesce(F.col("max_turn") - F.col("min_turn") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    fields = ["conv", gaps, "blank", "duplicate", "truncated", "illegal", "cost"]
    return parts, pieces.where("whole").select(fields).unionByName(report.select(fields))
