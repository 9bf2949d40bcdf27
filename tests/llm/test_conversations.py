"""Conversation repair against brute force."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidelog.llm.conversation_repair import START, _forward, borders, conversation_repair, damaged, edits, matrix
from tidelog.llm.queries import op11_conversation_repair

SPACE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def brute(rows, ids):
    """All (cost, audit, lines) of the automaton, the least of each state kept with its whole audit."""
    out = []
    for conv in ids:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, counts, best = set(), dict.fromkeys(("blank", "duplicate", "truncated"), 0), {"": (0, "", [])}
        grow = lambda b: {**b, **{k: v for k, v in insert(b).items() if k not in b or v[:2] < b[k][:2]}}

        def insert(b):
            found = {}
            for state, (cost, audit, lines) in b.items():
                role = "assistant" if state == "u" else "user"
                new = (cost + 5, audit + "I", [*lines, f"{role}:"])
                found[role[0]] = min(new, found.get(role[0], new))
            return found

        for _, role, text in own:
            fault = "blank" if not text.strip(SPACE) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(SPACE)[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            now = {}
            # Inserts before a row may be several, so audits of one state can have different lengths; all that could still win are tried.
            starts = [best, insert(best), insert(insert(best))]
            for b in starts:
                for state, (cost, audit, lines) in b.items():
                    ways = [(state, 2, "D", [])]
                    if fault not in ("blank", "duplicate"):
                        more = 5 * (fault == "truncated")
                        want = "assistant" if state == "u" else "user"
                        ways.append((want[0], 1 + more, "R", [f"{want}:{text}"]))
                        if role[:1] == want[0] or (state == "" and role[:1] == "s"):
                            ways.append((role[0], more, "K", [f"{role}:{text}"]))
                    for to, c, letter, line in ways:
                        new = (cost + c, audit + letter, lines + line)
                        now[to] = min(new, now.get(to, new))
            best = now
        best = grow(grow(best))
        cost, audit, lines = min(v for k, v in best.items() if k in ("", "a"))
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        out.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def made(rng, n_convs, longest):
    for conv in [None, *range(n_convs)]:
        turn = 0
        for _ in range(rng.randrange(0, longest)):
            turn += rng.choice([0, 1, 1, 1, 1, 3])
            text = rng.choice(["Yes.", "No!", "open end", "", " \n", "Why? ", "Yes.", "é ok.\n", None, f"text {rng.randrange(9)}."])
            yield conv, rng.choice([turn] * 9 + [None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "unknown"]), text


def key(row):
    return (row[0] is None, row[0] or 0)


@pytest.mark.parametrize("n_convs,longest,parts", [(60, 9, 3), (4, 150, 7)])
def test_conversation_repair(spark, n_convs, longest, parts):
    rows = list(made(random.Random(n_convs), n_convs, longest))
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "conv_id bigint, turn bigint, role string, text string, gone string, seq int").repartition(parts)
    assert sorted(map(tuple, damaged(df).filter("not gone").drop("gone").collect()), key=str) == sorted(damage(rows), key=str)
    got = conversation_repair(damaged(df), F.col("gone"))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(damage(rows), {r[0] for r in rows}), key=key)
    plain = [(c, t, r or " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert sorted(map(tuple, conversation_repair(df).collect()), key=key) == sorted(brute(plain, {r[0] for r in rows}), key=key)


def test_query_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, op11_conversation_repair(spark, sf_dir).collect()), key=key) == sorted(brute(damage(rows), {r[0] for r in rows}), key=key)


def test_empty_and_all_gone(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert conversation_repair(damaged(none), F.col("gone")).collect() == []
    rows = spark.createDataFrame([(1, 1, "user", "a.")], none.schema)
    assert tuple(conversation_repair(rows, F.lit(True)).first()) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_halves_give_what_whole_vectors_give():
    rng = random.Random(9)
    for n in (0, 1, 2, 17, 60, 300):
        kinds = bytes(rng.randrange(12) for _ in range(n))
        cuts = sorted(rng.sample(range(n + 1), min(4, n + 1)))
        parts = [kinds[a:b] for a, b in zip([0, *cuts], [*cuts, n], strict=True)]
        states, cost = borders([matrix(p) for p in parts])
        whole, cost_2 = borders([matrix(kinds)])
        assert cost == cost_2 and states[0] == whole[0] == START and states[-1] == whole[-1]
        split = [e for p, a, b in zip(parts, states, states[1:], strict=False) for e in edits(p, a, b)]
        assert split == edits(kinds, START, whole[-1])
        assert _forward(kinds, START)[whole[-1]] is not None


def test_a_conversation_in_many_ranges(spark):
    """Three quarters of all rows are of one conversation; its duplicates lie in other ranges than what they repeat."""
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant"]), rng.choice(["Yes.", "No.", f"text {t}.", "open"])) for t in range(900)]
    rows += [(c, t, "user", "Hi.") for c in range(100, 200) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(6)
    got = sorted(map(tuple, conversation_repair(df).collect()), key=key)
    assert got == sorted(brute(rows, {r[0] for r in rows}), key=key)
