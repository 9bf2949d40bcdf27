"""Conversation structure repair by divide and conquer (Hirschberg).

A repaired conversation has role initials ``(s?(ua)+)?``: an automaton of four states. An edit takes one state to one
other, so what is known of a stretch of rows is a vector: for each state behind it the cost of the cheapest edits and
the rank of the least audit (string of edits) among them. Vectors from the front and from the back meet in the middle;
of the cheapest crossings the one with the least audit is taken, and both halves are solved the same way. Only states
are kept, so space is linear. Audits of equally many rows that end with an edit of a row are never prefixes of each
other, so ranks decide also for what follows.

Rows are sorted in ranges of (conversation, turn), so a conversation may lie in several tasks. Each task's stretch is
one matrix of 4 x 4 costs and ranks; along a conversation the matrices meet first, which fixes the states at the
borders, and then each stretch is solved on its own. Only the digest of a repaired text has to be made in one go, as
SHA-256 is: rows are streamed through it in order.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: States: nothing yet, behind a system row, behind a user row, behind an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
_BLANK = r"[\x20\x09-\x0D]"
_AFTER = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: Where a row of the expected role leads to, and that role.
_EXPECTED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Behind the last row: the inserts that end a conversation, and their cost.
_ENDS = {START: (0, ""), SYSTEM: (10, "II"), USER: (5, "I"), ASSISTANT: (0, "")}
_LEGAL = {"su", "ua", "au"}
#: Rows whose solution is remembered; rows of a chunk.
_SHORT, _CHUNK = 16, 1 << 16


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with the damage that crc32 of ``conv_id:turn`` names, nulls as one space: conv_id, turn, role, text, gone. A dropped row stays as one that is gone, so that its conversation isn't forgotten."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(blank("role"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind == 0).alias("gone"), F.explode(copies).alias("copy")).drop("copy")


@lru_cache
def _moves(kind: int) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, edits) of a row: inserts before it, then what happens to it. ``kind``: place of its initial in ``sua``, 3 for others, times 3; plus 1 if it is truncated, 2 if it must go."""
    initial, fault = "sua "[kind // 3], kind % 3
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for state in range(4):
        at = state
        for inserts in range(3):
            options = [(at, 2, "D")]
            if fault < 2:
                options.append((_EXPECTED[at], 1 + 5 * fault, "R"))
                if initial in _AFTER[at]:
                    options.append((_AFTER[at][initial], 5 * fault, "K"))
            for to, cost, letter in options:
                found = (cost + 5 * inserts, "I" * inserts + letter)
                best[state, to] = min(found, best.get((state, to), found))
            at = _EXPECTED[at]
    return [(a, b, *found) for (a, b), found in sorted(best.items())]


def _forward(kinds: bytes, start: int) -> list[tuple[int, int] | None]:
    """(cost, rank of the least audit) of each state behind these rows."""
    now: list[tuple[int, int] | None] = [(0, 0) if s == start else None for s in range(4)]
    for kind in kinds:
        best: list[tuple[int, int, str] | None] = [None] * 4
        for a, b, cost, edits in _moves(kind):
            if now[a] is not None:
                found = (now[a][0] + cost, now[a][1], edits)
                best[b] = found if best[b] is None else min(found, best[b])
        order = {x: i for i, x in enumerate(sorted(x[1:] for x in best if x))}
        now = [x and (x[0], order[x[1:]]) for x in best]
    return now


def _backward(kinds: bytes, end: int) -> list[int | None]:
    """The cost from each state before these rows to the state ``end`` behind them."""
    now: list[int | None] = [0 if s == end else None for s in range(4)]
    for kind in reversed(kinds):
        best: list[int | None] = [None] * 4
        for a, b, cost, _ in _moves(kind):
            if now[b] is not None:
                best[a] = now[b] + cost if best[a] is None else min(best[a], now[b] + cost)
        now = best
    return now


def _crossing(front: list, back: list) -> int:
    """The state at which the cheapest way crosses, of several that of the least audit."""
    return min((front[s][0] + back[s], front[s][1], s) for s in range(4) if front[s] is not None and back[s] is not None)[2]


def edits(kinds: bytes, start: int, end: int) -> list[str]:
    """For each row the inserts before it and its own edit, along the cheapest way between two states."""
    return list(_short_edits(kinds, start, end)) if len(kinds) <= _SHORT else _halved(kinds, start, end)


@lru_cache(1 << 16)
def _short_edits(kinds: bytes, start: int, end: int) -> tuple[str, ...]:
    return tuple(_halved(kinds, start, end))


def _halved(kinds: bytes, start: int, end: int) -> list[str]:
    if len(kinds) <= 1:
        return [edits for kind in kinds for a, b, _, edits in _moves(kind) if (a, b) == (start, end)]
    middle = len(kinds) // 2
    state = _crossing(_forward(kinds[:middle], start), _backward(kinds[middle:], end))
    return edits(kinds[:middle], start, state) + edits(kinds[middle:], state, end)


def matrix(kinds: bytes) -> list[list[tuple[int, int] | None]]:
    return _short_matrix(kinds) if len(kinds) <= _SHORT else [_forward(kinds, s) for s in range(4)]


@lru_cache(1 << 16)
def _short_matrix(kinds: bytes) -> list:
    return [_forward(kinds, s) for s in range(4)]


def borders(matrices: list) -> tuple[list[int], int]:
    """The state before each stretch of a conversation and behind the last one, along the cheapest way from nothing to its end; and the cost."""
    fronts = [[(0, 0), None, None, None]]
    for m in matrices:
        reached = [[(f[0] + m[a][b][0], (f[1], m[a][b][1])) for a, f in enumerate(fronts[-1]) if f is not None and m[a][b] is not None] for b in range(4)]
        least = [min(x, default=None) for x in reached]
        order = {rank: i for i, rank in enumerate(sorted(x[1] for x in least if x))}
        fronts.append([x and (x[0], order[x[1]]) for x in least])
    states = [_crossing(fronts[-1], [_ENDS[s][0] for s in range(4)])]
    cost = fronts[-1][states[0]][0] + _ENDS[states[0]][0]
    for front, m in zip(fronts[-2::-1], reversed(matrices), strict=True):
        states.append(_crossing(front, [m[a][states[-1]] and m[a][states[-1]][0] for a in range(4)]))
    return states[::-1], cost


def _rows(batches):
    for batch in batches:
        yield from batch.to_pylist()


def _batched(rows, schema, size: int = 4096, most_bytes: int = 8 << 20):
    import pyarrow as pa

    held, n_bytes = [], 0
    for row in rows:
        held.append(row)
        n_bytes += len(row.get("text") or "")
        if len(held) >= size or n_bytes >= most_bytes:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, n_bytes = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _mapped(df: DataFrame, function, ddl: str) -> DataFrame:
    """``function`` over the rows (dicts) of each partition, in their order."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(ddl))
    return df.mapInArrow(lambda batches: _batched(function(_rows(batches)), schema), ddl)


def _placed(rows):
    """Rows of a sorted partition with their number in it (seq), that of the first row of their conversation (chunk), and whether role and text came up earlier in it. A chunk has _CHUNK rows at most."""
    last, chunk, seen = None, -1, set()
    for seq, row in enumerate(rows):
        if chunk < 0 or row["conv_id"] != last:
            last, chunk, seen = row["conv_id"], seq, set()
        elif seq - chunk >= _CHUNK:
            chunk = seq
        key = (row.pop("k1"), row.pop("k2"))
        fit = not (row["gone"] or row["blank"])
        yield row | {"seq": seq, "chunk": chunk, "again": fit and key in seen, "k1": key[0], "k2": key[1]}
        if fit:
            seen.add(key)


def _kind(row: dict) -> int:
    place = "sua".find(row["initial"]) if row["initial"] else -1
    return 3 * (3 if place < 0 else place) + (2 if row["blank"] or row["again"] else 1 if row["truncated"] else 0)


def _summed(rows):
    """One row a chunk: its matrix and counts."""
    for (part, chunk), run in groupby(rows, lambda r: (r["part"], r["chunk"])):
        run = list(run)
        conv, run = run[0]["conv_id"], [r for r in run if not r["gone"]]
        turns = sorted({r["turn"] for r in run if r["turn"] is not None})
        initials = [r["initial"] for r in run]
        m = matrix(bytes(map(_kind, run)))
        yield {
            "part": part, "chunk": chunk, "conv_id": conv, "blank": sum(r["blank"] for r in run), "duplicate": sum(r["again"] for r in run),
            "truncated": sum(r["truncated"] and not r["again"] for r in run), "illegal": sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:], strict=False)),
            "first": initials[0] if run else None, "last": initials[-1] if run else None, "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "turns": len(turns),
            "costs": [x and x[0] for line in m for x in line], "ranks": [x and x[1] for line in m for x in line],
        }


def _solved(rows):
    """One row a chunk: the states at its borders; the counts and the ending of a conversation come with its last chunk."""
    key = lambda r: (r["conv_id"] is None, r["conv_id"])
    for _, run in groupby(rows, key):
        run = list(run)
        flat = [[None if x is None else (x, y) for x, y in zip(r["costs"], r["ranks"], strict=True)] for r in run]
        states, cost = borders([[f[4 * i : 4 * i + 4] for i in range(4)] for f in flat])
        full, dated = [r for r in run if r["first"] is not None], [r for r in run if r["turns"]]
        turns = sum(r["turns"] for r in dated) - sum(a["high"] == b["low"] for a, b in zip(dated, dated[1:], strict=False))
        whole = {c: sum(r[c] for r in run) for c in ("blank", "duplicate", "truncated", "illegal")} | {"cost": cost, "gaps": dated[-1]["high"] - dated[0]["low"] + 1 - turns if dated else 0, "ending": _ENDS[states[-1]][1]}
        whole["illegal"] += sum(a["last"] + b["first"] not in _LEGAL for a, b in zip(full, full[1:], strict=False))
        for i, r in enumerate(run):
            yield {"part": r["part"], "chunk": r["chunk"], "conv_id": r["conv_id"], "from": states[i], "to": states[i + 1]} | (whole if i == len(run) - 1 else {})


def _edited(rows):
    """One row for each row that isn't gone: its edits."""
    for _, run in groupby(rows, lambda r: (r["part"], r["chunk"])):
        run = [r for r in run if not r["gone"]]
        if run:
            for r, e in zip(run, edits(bytes(map(_kind, run)), run[0]["from"], run[0]["to"]), strict=True):
                yield {"conv_id": r["conv_id"], "part": r["part"], "seq": r["seq"], "edit": e}


def _repaired(rows):
    """The result of each conversation: its edits in order, and the digest of the repaired rows, which stream through it. An edit comes before the row that it is for."""
    for _, run in groupby(rows, lambda r: (r["conv_id"] is None, r["conv_id"])):
        audit, digest, state, first, whole, edit, conv = [], hashlib.sha256(), START, True, None, "", None

        def say(line: str) -> None:
            nonlocal first
            digest.update(("" if first else "\n").encode() + line.encode())  # noqa: B023
            first = False

        def insert(letters: str) -> None:
            nonlocal state
            for _ in letters:
                state = _EXPECTED[state]
                say(f"{_ROLE[state]}:")

        for r in run:
            conv = r["conv_id"]
            if r["ending"] is not None:
                whole = r
            elif r["edit"] is not None:
                edit = r["edit"]
                audit.append(edit)
            elif r["text"] is not None:
                insert(edit[:-1])
                if edit[-1] == "K":
                    state = _AFTER[state][r["role"][:1]]
                    say(f"{r['role']}:{r['text']}")
                elif edit[-1] == "R":
                    state = _EXPECTED[state]
                    say(f"{_ROLE[state]}:{r['text']}")
        insert(whole["ending"])
        yield {"conv_id": conv} | {c: whole[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")} | {"audit": "".join(audit) + whole["ending"], "repaired_sha256": digest.hexdigest()}


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def conversation_repair(rows: DataFrame, gone: Column | None = None) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, more), but for those that are ``gone``, to one row for each conv_id, also of these: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows stand by turn, nulls first; rows of one turn by role and text, in byte order, so that copies are neighbours.
    The first of these is the fault of a row: blank, duplicate (role and text came up earlier), truncated (doesn't end
    with ``.!?``). ``illegal`` counts neighbours whose role initials aren't su, ua or au, ``gaps`` the turns that are
    missing between the first and the last. ``audit`` has the cheapest edits: K keep, R give the expected role, D
    delete, I insert an empty row of the expected role; of several the least in byte order. A null role or text counts
    as one space, a null conv_id as a conversation of its own. One without rows, or with rows that are gone only, has
    zeros, an empty audit and the digest of nothing. Other columns are not read. An empty table gives an empty table.
    """
    kind, turn = (rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    gone = F.lit(False) if gone is None else gone
    said = [F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")]
    read = rows.select("conv_id", "turn", *said, gone.alias("gone"), F.monotonically_increasing_id().alias("nr"))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text", "nr"]
    read = read.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    truncated = ~blank & ~F.col("text").rlike(rf"[.!?]{_BLANK}*\z")
    keys = [F.xxhash64("role", "text").alias("k1"), F.xxhash64(F.lit(7), "role", "text").alias("k2")]
    read = read.select("part", "conv_id", "turn", "role", "text", "gone", blank.alias("blank"), truncated.alias("truncated"), *keys)
    placed = materialize(_mapped(read, _placed, f"part int, conv_id {kind}, turn {turn}, role string, text string, gone boolean, blank boolean, truncated boolean, seq bigint, chunk bigint, again boolean, k1 bigint, k2 bigint"))

    # A range knows its own duplicates. Of a conversation in several ranges (at most one a border between them), the first rows of each range are held against each other.
    wide = placed.groupBy("conv_id").agg(F.min("part").alias("a"), F.max("part").alias("b")).filter("a < b").select(F.col("conv_id").alias("wide"))
    known = placed.filter("not gone and not blank and not again").join(F.broadcast(wide), _same("conv_id", "wide"))
    earliest = known.groupBy("conv_id", "k1", "k2").agg(F.sort_array(F.collect_list(F.struct("part", "seq"))).alias("at")).filter("size(at) > 1")
    repeats = materialize(earliest.select(F.explode(F.expr("slice(at, 2, size(at) - 1)")).alias("at")).select("at.part", "at.seq", F.lit(True).alias("repeats")))

    brief = placed.select("part", "chunk", "seq", "conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "gone", "blank", "truncated", F.col("again").alias("own"))
    brief = brief.join(repeats, ["part", "seq"], "left").withColumn("again", F.col("own") | F.coalesce("repeats", F.lit(False))).drop("own", "repeats")
    by_chunk = brief.repartition("part", "chunk").sortWithinPartitions("part", "seq")
    counts = "blank bigint, duplicate bigint, truncated bigint, illegal bigint"
    sums = _mapped(by_chunk, _summed, f"part int, chunk bigint, conv_id {kind}, {counts}, first string, last string, low {turn}, high {turn}, turns bigint, costs array<bigint>, ranks array<int>")
    solved = _mapped(sums.repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk"), _solved, f"part int, chunk bigint, conv_id {kind}, from int, to int, {counts}, cost bigint, gaps bigint, ending string")
    solved = materialize(solved)
    edited = _mapped(brief.join(solved.select("part", "chunk", "from", "to"), ["part", "chunk"]).repartition("part", "chunk").sortWithinPartitions("part", "seq"), _edited, f"conv_id {kind}, part int, seq bigint, edit string")

    parts = [edited.withColumn("nr", F.lit(0)), placed.filter("not gone").select("conv_id", "part", "seq", "role", "text", F.lit(1).alias("nr")), solved.filter("ending is not null").select("conv_id", "part", F.lit(-1).cast("bigint").alias("seq"), F.lit(0).alias("nr"), "gaps", *counts.replace(" bigint", "").split(", "), "cost", "ending")]
    stacked = parts[2].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[0], allowMissingColumns=True)
    out = f"conv_id {kind}, gaps bigint, {counts}, cost bigint, audit string, repaired_sha256 string"
    return _mapped(stacked.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq", "nr"), _repaired, out)
