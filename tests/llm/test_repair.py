import hashlib
import random
import re
from functools import lru_cache

import pytest

from chatterloom.llm import repair as R

INITIAL = {"s": R.SYSTEM, "u": R.USER, "a": R.ASSISTANT}


def code_of(role, text, again):
    said = text.rstrip(R.SPACE)
    fault = R.BLANK if not said else R.DUPLICATE if again else R.FINE if said[-1] in ".!?" else R.CUT
    return INITIAL.get(role[:1], R.OTHER) + 4 * fault


def every_repair(turns, inserts=3):
    """Cost, audit and role initials of all strings of edits with few inserts, the legal ones only."""

    @lru_cache(None)
    def tails(i, left):
        out = []
        if left:
            for x in "ua":
                out += [(3 + c, "I" + a, x + r) for c, a, r in tails(i, left - 1)]
        if i == len(turns):
            return out + [(0, "", "")]
        fault, initial = divmod(turns[i], 4)
        out += [(4 + c, "D" + a, r) for c, a, r in tails(i + 1, left)]
        if fault not in (R.BLANK, R.DUPLICATE):
            more = 3 if fault == R.CUT else 0
            for x, w, e in [("?sua"[initial], 0, "K"), ("u", 3, "R"), ("a", 3, "R")]:
                out += [(w + more + c, e + a, x + r) for c, a, r in tails(i + 1, left)]
        return out

    return [x for x in tails(0, inserts) if re.fullmatch("(s?(ua)+)?", x[2])]


@pytest.mark.parametrize("seed", range(60))
def test_lightest_among_all_repairs(seed):
    rng = random.Random(seed)
    turns = bytes(rng.choice([0, 1, 2, 3, 2, 3, 3, 6, 9, 14, 15, 13]) for _ in range(rng.randrange(0, 6)))
    cost, audit, _ = min(every_repair(turns))
    assert R.lightest_repair(turns) == (cost, audit)
    assert R.lightest_repair(turns, block=1) == R.lightest_repair(turns, block=2) == (cost, audit)


def test_agenda_pops_lightest_first_and_stops_at_the_goal():
    popped = []

    def deductions(item):
        popped.append(item)
        return {"a": [("b", 1, "z"), ("c", 0, "y")], "b": [("goal", 0, "q")], "c": [("b", 1, "a")]}.get(item, [])

    assert R.lightest([("a", (0, ""))], deductions, lambda x: x == "goal") == {"goal": (1, "yaq")}
    assert popped == ["a", "c", "b"]


def test_long_conversations_in_blocks_equal_one_agenda():
    rng = random.Random(8)
    turns = bytes(rng.choice([1, 2, 3, 2, 3, 6, 14, 13, 0]) for _ in range(1500))
    assert R.lightest_repair(turns) == R.lightest_repair(turns, block=10_000)


def plain(rows):
    """The whole operator for (key, turn, role, text) rows, keyed by the key."""
    talks = {}
    for key, turn, role, text in rows:
        talks.setdefault(key, []).append((turn, role or "", text or ""))
    out = {}
    for key, said in talks.items():
        said.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        seen, codes = set(), []
        for _, role, text in said:
            codes.append(code_of(role, text, (role, text) in seen))
            seen.add((role, text))
        cost, audit = R.lightest_repair(bytes(codes), block=10_000)
        lines, i, state = [], 0, ""
        for e in audit:
            given = "assistant" if state.endswith("u") else "user"
            if e == "I":
                lines.append(f"{given}:")
            elif e != "D":
                lines.append(f"{said[i][1] if e == 'K' else given}:{said[i][2]}")
            if e != "D":
                state += lines[-1][0]
            i += e != "I"
        assert re.fullmatch("(s?(ua)+)?", state)
        turns = [t for t, _, _ in said if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(said, said[1:])]
        out[key] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(sum(c // 4 == f for c in codes) for f in (1, 2, 3)),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def talks(seed=4):
    rng, rows = random.Random(seed), []
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "System", "under"]
    texts = ["Yes.", "No", "Why? \t", "", " \x0b", None, "Again!", "end .\x85", "a:b\nuser:c."]
    for key in range(40):
        for turn in range(rng.randrange(1, 14)):
            rows.append((key, rng.choice([turn, turn, turn * 2, None]), rng.choice(roles), rng.choice(texts)))
    rows += [(90, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(700)]
    rows += [(91, t, "user", "the same") for t in range(400)] + [(92, 0, "user", "long " * 100_000 + "?")]
    rows += [(None, 1, "user", "No key."), (None, 2, "assistant", "None."), (93, None, None, None), (94, -5, "user", "x."), (94, 5, "assistant", "y.")]
    return rows + rows[:3]


def test_equals_plain_loop(spark):
    rows = talks()
    fields = "conv_id long, turn long, role string, text string, n string, code string, k string, letters string"
    turns = spark.createDataFrame([(*r, "n", "c", "k", "l") for r in rows], fields).repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in R.repaired(turns).collect()}
    assert got == plain(rows)


def test_repaired_turns_of_string_keys_in_small_batches(spark):
    rows = [(f"key {k}", *r) for k, *r in talks(5) if k is not None]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        made = R.Repair(spark.createDataFrame(rows, "who string, at int, part string, said string"),
                        key="who", turn="at", role="part", text="said")
        kept = {}
        for r in sorted(made.turns().collect(), key=lambda r: r.position):
            kept.setdefault(r.who, []).append(f"{r.role}:{r.text}")
        digests = {r.who: r.repaired_sha256 for r in made.digests().collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, empty = plain(rows), hashlib.sha256(b"").hexdigest()
    assert {k: hashlib.sha256("\n".join(v).encode()).hexdigest() for k, v in kept.items()} == digests
    assert {k: digests.get(k, empty) for k in want} == {k: v[-1] for k, v in want.items()}


def test_empty(spark):
    made = R.repaired(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert made.count() == 0
    assert made.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
