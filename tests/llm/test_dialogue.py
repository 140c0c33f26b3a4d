import hashlib
import random
import zlib

import pytest

from hirelake.llm import dialogue
from hirelake.llm.queries import QUERIES

SCHEMA = "conv_id bigint, turn bigint, role string, text string, chunk int, code string"
BLANK = " \t\n\x0b\x0c\r"


def brute_damage(rows):
    for conv, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(key.encode()) % 20
        text = {1: "", 2: "".join(c for c in text if c not in ".!?")}.get(fault, text)
        role = "user" if fault == 4 else role
        yield from [(conv, turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)


def brute_repair(rows):
    """Everything the report holds of one conversation; the search keeps the cheapest, least audit and its rows of each state, row by row."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    turns = {r[1] for r in rows if r[1] is not None}
    seen, faults = set(), []
    for _, _, role, text in rows:
        last = text.rstrip(BLANK)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last in ".!?" else "truncated")
        seen.add((role, text))
    initials = [r[2][:1] for r in rows]
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}
    best = {"": (0, "", ())}

    def inserted(best):
        out = dict(best)
        for _ in range(3):
            for q, (cost, audit, kept) in list(out.items()):
                after = follow[q][-1]
                option = (cost + 3, audit + "I", (*kept, f"{names[after]}:"))
                out[after] = min(out.get(after, option), option)
        return out

    for (_, _, role, text), fault, initial in zip(rows, faults, initials):
        now = {}
        for q, (cost, audit, kept) in inserted(best).items():
            options = [(q, (cost + 4, audit + "D", kept))]
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                if initial and initial in follow[q]:
                    options.append((initial, (cost + extra, audit + "K", (*kept, f"{role}:{text}"))))
                options += [(x, (cost + 3 + extra, audit + "R", (*kept, f"{names[x]}:{text}"))) for x in follow[q] if x != "s"]
            for state, option in options:
                now[state] = min(now.get(state, option), option)
        best = now
    cost, audit, kept = min(v for q, v in inserted(best).items() if q in ("", "a"))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())


def brute(rows):
    by = {r[0]: [] for r in rows}
    for r in brute_damage(rows):
        by[r[0]].append(r)
    return {conv: brute_repair(own) for conv, own in by.items()}


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def conversations(seed, convs, longest):
    rng, rows = random.Random(seed), []
    for conv in range(convs):
        kind = rng.choice(["alternate", "user", "any"])
        for turn in range(rng.randint(1, longest)):
            role = {"alternate": ["user", "assistant"][turn % 2], "user": "user"}.get(kind) or rng.choice(["system", "user", "assistant", "tool", "", None])
            if turn == 0 and rng.random() < 0.3:
                role = "system"
            rows.append((conv, turn if rng.random() < 0.95 else None, role, rng.choice([f"Text {turn}.", f"Text {turn}", "Again?", " \n", "É fin! ", None, f"Ende {turn}"])))
    return rows


SPECIAL = [(None, 1, "user", "No id."), (None, None, None, None), (7000, 0, "user", "Long. " * 40_000), (7000, 1, "assistant", "ok."), (7000, 1, "assistant", "ok."),
           (7001, -9223372036854775808, "user", "Far."), (7001, 9223372036854775807, "assistant", "Away."), (7002, 5, "system", "Only."), (7003, 2, "USER", "Case.")]


@pytest.mark.parametrize("bits", [2, 16])
def test_report_matches_brute_force(spark, bits):
    rows = conversations(bits, 60, 40) + SPECIAL
    out = dialogue.repair_report(dialogue.damage_rows(frame(spark, rows)), frame(spark, rows), bits).collect()
    got = {r.conv_id: tuple(r)[1:] for r in out}
    want = brute(rows)
    want[7001] = (None if want[7001][0] >= 2**63 else want[7001][0], *want[7001][1:])
    assert len(out) == len(got) and {k: v for k, v in got.items() if k != 7001} == {k: v for k, v in want.items() if k != 7001}
    assert got[7001][1:] == want[7001][1:]


@pytest.mark.parametrize("role", ["user", "assistant"])
def test_a_long_run_of_one_role_needs_fix_up_passes(spark, role):
    """Its vectors alternate for ever, so half of the chunks meet a vector that they have not run from."""
    rows = [(n, i, role, f"Text {i}.") for n in (50, 51) for i in range(n)]
    got = dialogue.repair_report(frame(spark, rows).select("conv_id", "turn", "role", "text"), frame(spark, rows), 2).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == {n: brute_repair([r for r in rows if r[0] == n]) for n in (50, 51)}


def test_repaired_rows_are_made_chunk_by_chunk(spark):
    rows = conversations(3, 40, 30)
    placed = dialogue.place_rows(dialogue.damage_rows(frame(spark, rows)), 2)
    audits = dialogue.audit_chunks(dialogue.make_chunks(placed, 2))
    lines = {}
    for r in sorted(dialogue.repaired_rows(placed, audits).collect(), key=lambda r: r.seq if r.seq >= 0 else 0):
        lines.setdefault(r.conv, []).append((r.edit, f"{r.role}:{r.text}"))
    for conv, want in brute(rows).items():
        own = lines.get(conv, [])
        assert sorted(e for e, _ in own) == sorted(want[-2].replace("D", ""))
    assert {r.edit for r in dialogue.repaired_rows(placed, audits).collect()} <= set("KRI")


def test_rank_convergence_stops_at_equal_vectors():
    costs = dialogue.Costs()
    codes = bytes(random.Random(1).choice([0, 1, 1, 2, 2, 3, 5, 6, 8, 12]) for _ in range(500))
    for start in costs.vectors():
        assert costs.rerun(codes, start, dialogue.END, costs.run(codes, dialogue.END)) == costs.run(codes, start)


def test_no_rows(spark):
    none = frame(spark, []).select("conv_id", "turn", "role", "text")
    assert dialogue.repair_report(none, none).collect() == []
    ids = spark.createDataFrame([(1,), (None,)], "conv_id bigint")
    got = dialogue.repair_report(none, ids).collect()
    assert [tuple(r)[1:] for r in got] == [(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())] * 2


def test_query_matches_brute_force(spark):
    out = QUERIES["op11_conversation_repair"](spark, "/root/testdata/sf0.001").collect()
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()]
    assert {r.conv_id: tuple(r)[1:] for r in out} == brute(rows)
