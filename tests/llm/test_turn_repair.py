import hashlib
import itertools
import random
import re
import zlib

import pytest

from judge_jobs.llm import turn_repair
from judge_jobs.llm.queries import op11_turn_repair

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
WS = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub(r"[.!?]", "", text) if kind == 2 else text
            out += [(c, t, "user" if kind == 4 else role, text)] * (1 + (kind == 3))
    return out


def faults(rows):
    """Rows of one conversation in order: each one's first fault."""
    seen, out = set(), []
    for _, _, role, text in rows:
        body = text.rstrip(WS)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def right_linear(rows, found):
    """The cheapest edits by going through states from the last row to the first: no spans, no cells to join.

    Value: (cost, audit, turns of the result after this).
    """
    n = len(rows)
    state = {"": 0, "s": 1, "u": 2, "a": 3}
    after = {0: "su", 1: "u", 2: "a", 3: "u"}
    best = [dict() for _ in range(n + 1)]
    for i in range(n, -1, -1):
        plain = {}
        for q in range(4):
            options = [(0, "", ())] if i == n and q in (0, 3) else []
            if i < n:
                _, _, role, text = rows[i]
                step = lambda cost, letter, x, line: [(cost + best[i + 1][r][0], letter + best[i + 1][r][1], line + best[i + 1][r][2]) for r in [state[x] if x is not None else q] if r in best[i + 1]]
                options += step(3, "D", None, ())
                if found[i] not in ("blank", "duplicate"):
                    more = found[i] == "truncated"
                    if role[:1] in tuple(after[q]):
                        options += step(more, "K", role[:1], ((role, text),))
                    for x, name in (("u", "user"), ("a", "assistant")):
                        if x in after[q]:
                            options += step(2 + more, "R", x, ((name, text),))
            if options:
                plain[q] = min(options)
        best[i] = dict(plain)
        for _ in range(3):  # insertions before this row
            for q in range(4):
                for x, name in (("u", "user"), ("a", "assistant")):
                    if x in after[q] and state[x] in best[i]:
                        cost, audit, lines = best[i][state[x]]
                        option = (cost + 2, "I" + audit, ((name, ""), *lines))
                        best[i][q] = min(best[i].get(q, option), option)
    return best[0][0]


def brute(rows):
    convs = {}
    for r in rows:
        convs.setdefault(r[0], [])
    for r in damage(rows):
        convs[r[0]].append(r)
    out = []
    for c, own in convs.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3][: turn_repair.HEAD], hashlib.md5(f"{'' if c is None else c}:{len(r[2])}:{r[2]}{r[3]}".encode()).digest()))
        found = faults(own)
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, lines = right_linear(own, found)
        sha = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in lines).encode()).hexdigest()
        out.append((c, gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit, sha))
    return sorted(out, key=str)


def made(seed, n, most=9):
    rng, rows = random.Random(seed), []
    for c in [*range(n), None]:
        turn = 0
        for k in range(rng.randint(1, most)):
            turn += rng.choice([1, 1, 1, 1, 3])
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""]) if rng.random() < 0.4 else ("user", "assistant")[k % 2]
            text = rng.choice(["Short.", "Long text! \n", "no end", "", " \t\r\x0b\x0c\n", "Was it? ", " ", "Dots.\x85", None, f"own {turn}.", "x" * 40 + "a.", "x" * 40 + "b."])
            rows.append((c, None if rng.random() < 0.05 else turn if rng.random() < 0.95 else turn - 1, role, text))
    return rows


def query(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/conversations.parquet")
    found = op11_turn_repair(spark, str(path))
    assert found.columns == COLUMNS
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, tmp_path, seed):
    rows = made(seed, 150)
    assert query(spark, rows, tmp_path) == brute(rows)


@pytest.mark.parametrize("block", [1, 2, 5])
def test_blocks_of_any_size(spark, tmp_path, monkeypatch, block):
    """One conversation with a third of the rows and more, and one row repeated, over many blocks and ranges."""
    monkeypatch.setattr(turn_repair, "BLOCK", block)
    rng = random.Random(7)
    rows = made(8, 40) + [(500, t, rng.choice(["user", "assistant"]), f"{t}" + rng.choice([".", ""])) for t in range(150)] + [(501, t % 3, "user", "again.") for t in range(60)]
    assert query(spark, rows, tmp_path) == brute(rows)


def exhaustive(initials, unwanted, truncated):
    """Every way to edit, with up to three insertions between rows, tried against the pattern."""
    best = None
    gaps = list(itertools.product(*[["", "I", "II", "III"]] * (len(initials) + 1)))
    for letters in itertools.product("KRD", repeat=len(initials)):
        if any(w and x != "D" for w, x in zip(unwanted, letters)):
            continue
        price = sum({"K": 0, "R": 2, "D": 3}[x] + (t and x != "D") for x, t in zip(letters, truncated))
        for gap in gaps:
            audit = "".join(g + x for g, x in zip(gap, letters)) + gap[-1]
            cost = price + 2 * audit.count("I")
            if best and (cost, audit) >= best:
                continue
            slots = [x for g, i, x in zip(gap, initials, letters) for x in [*g.replace("I", "?"), {"K": i, "R": "?", "D": ""}[x]] if x] + list(gap[-1].replace("I", "?"))
            shape = "".join(slots)
            if any(len(shape) == len(p) and all(a in ("?", b) and (a != "?" or b != "s") for a, b in zip(shape, p)) for p in ["", *[s + "ua" * k for s in ("", "s") for k in range(1, 9)]]):
                best = (cost, audit)
    return best


def test_cells_against_every_edit():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randint(0, 3)
        initials = [rng.choice("suua-") for _ in range(n)]
        unwanted, truncated = [rng.random() < 0.2 for _ in range(n)], [rng.random() < 0.3 for _ in range(n)]
        cell = turn_repair.parse([turn_repair.turn_cell(*x) for x in zip(initials, unwanted, [t and not u for t, u in zip(truncated, unwanted)])])
        got = min(cell[k] for k in turn_repair.ACCEPTED if k in cell)
        assert got == exhaustive(initials, unwanted, [t and not u for t, u in zip(truncated, unwanted)])


def test_any_split_gives_the_same_cell():
    """The full chart, every split of every span, agrees with spans combined by length."""
    rng = random.Random(2)
    for _ in range(40):
        cells = [turn_repair.turn_cell(rng.choice("sua-"), rng.random() < 0.2, rng.random() < 0.2) for _ in range(rng.randint(1, 9))]
        chart = {(k, k + 1): c for k, c in enumerate(cells)}
        for length in range(2, len(cells) + 1):
            for a in range(len(cells) - length + 1):
                splits = [turn_repair.joined(chart[a, m], chart[m, a + length]) for m in range(a + 1, a + length)]
                assert all(s == splits[0] for s in splits)
                chart[a, a + length] = splits[0]
        assert turn_repair.parse(cells) == chart[0, len(cells)]


def test_repaired_rows(spark):
    """Rows of the general interface: other names, clashing extra columns, long texts, and what has to go."""
    from pyspark.sql import functions as F

    long = "word " * 500_000 + "end."
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "assistant", "Hello."), (1, 3, "user", long), (2, 0, "user", "")]
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("text", "body").withColumns({c: F.lit(1) for c in ("text", "key", "at", "kind", "part", "block", "cell")})
    whole, repaired = turn_repair.repair(turn_repair.clean(df, text_col="body"))
    assert {(r.conv_id, r.duplicate, r.cost, r.audit) for r in whole.collect()} == {(1, 1, 7, "KIKDKI"), (2, 0, 3, "D")}
    got = {(r.conv_id, r.at): (r.role, r.text, r.edit) for r in repaired.collect()}
    assert got == {(1, 0): ("system", "Be kind.", "K"), (1, 1): ("user", "", "I"), (1, 2): ("assistant", "Hello.", "K"), (1, 3): ("user", long, "K"), (1, 4): ("assistant", "", "I")}


def test_empty(spark, tmp_path):
    assert query(spark, [], tmp_path) == []
