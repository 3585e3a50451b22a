import random
import re
from hashlib import sha256
from zlib import crc32

import pytest

from gridloom.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string"
WORDY = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(rows):
    """(cost, least edits) by following every edit list that may still be best, longest lists last."""
    best = {(0, 0): (0, "")}
    work = [(0, 0)]
    while work:
        row, state = work.pop()
        cost, edits = best[row, state]

        def offer(r, s, c, e):
            if (r, s) not in best or (c, e) < best[r, s]:
                best[r, s] = (c, e)
                work.append((r, s))

        given = 3 if state == 2 else 2
        if edits.count("I") < 2 * len(rows) + 4:
            offer(row, given, cost + 5, edits + "I")
        if row < len(rows):
            role, fault = rows[row]
            offer(row + 1, state, cost + 2, edits + "D")
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                offer(row + 1, given, cost + 1 + extra, edits + "R")
                fits = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((role[:1], state))
                if fits is not None:
                    offer(row + 1, fits, cost + extra, edits + "K")
    return min(best[len(rows), s] for s in (0, 3) if (len(rows), s) in best)


def plain(rows):
    """The report and hash of every conversation, one after another."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = role if role is not None else " ", text if text is not None else " "
            k = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if k == 0:
                continue
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            own += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha256(r[2].encode()).hexdigest()))
        faults, seen = [], set()
        for _, role, text in own:
            last = WORDY.findall(text)
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else "good")
            seen.add((role, text))
        turns = {t for t, _, _ in own if t is not None}
        cost, audit = cheapest([(role, f) for (_, role, _), f in zip(own, faults)])
        lines, state, at = [], 0, 0
        for e in audit:
            given = 3 if state == 2 else 2
            if e == "K":
                state = {"s": 1, "u": 2, "a": 3}[own[at][1][0]]
                lines.append(f"{own[at][1]}:{own[at][2]}")
            elif e in "IR":
                state = given
                lines.append(("", "", "user", "assistant")[given] + ":" + (own[at][2] if e == "R" else ""))
            at += e != "I"
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:])]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def found(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def made(seed, conversations, longest):
    rng = random.Random(seed)
    texts = ["Well then.", "No end", "  ", "", None, "Ünter!", "Again?", "Again?", "x\n", "y.\t"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]
    rows = []
    for conv in [None, *range(conversations)]:
        for turn in range(rng.randint(1, longest)):
            rows.append((conv, rng.choice([turn, turn, turn, turn // 2, None]), rng.choice(roles), rng.choice(texts)))
    return rows


def test_equals_a_plain_search(spark):
    rows = made(3, 60, 9)
    assert found(C.digest(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


@pytest.mark.parametrize("size", [1, 3])
def test_chunks_do_not_matter(spark, monkeypatch, size):
    rows = made(4, 12, 14)
    monkeypatch.setattr(C, "CHUNK", size)
    assert found(C.digest(spark.createDataFrame(rows, SCHEMA).repartition(5))) == plain(rows)


def test_one_long_conversation(spark):
    rows = [(7, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(20_000)]
    got = found(C.digest(spark.createDataFrame(rows, SCHEMA)))
    dropped = sum(crc32(f"7:{t}".encode()) % 20 == 0 for t in range(20_000))
    assert got[7][0] <= dropped and got[7][1] > 900 and len(got[7][6]) >= 20_000 - dropped


def test_long_runs_by_powers():
    end = C.END
    for symbol in "ABCDEFM":
        single = end
        for n in range(1, 40):
            single = C.applied(C.power(symbol, 0), single)
            assert C.before_run(symbol, n, end) == single
    edits, state = C.unrolled("B" * 1000, end, 0, True)  # users only
    assert state == 3 and edits.count("D") == 0 and len(edits) == 1000 and C.applied(C.transition("B" * 1000), end)[0] == 500


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.digest(empty).collect() == []
    rows = spark.createDataFrame([(1, 0, "user", "Hi.", "a", 5), (1, 1, "assistant", "Yes.", "b", 6)], SCHEMA + ", audit string, cost int")
    report, turns = C.repair(rows)
    assert [tuple(r) for r in report.collect()] == [(1, 0, 0, 0, 0, 0, 0, "KK")]
    assert [(r.edit, r.role, r.text) for r in turns.orderBy("chunk", "place").collect()] == [("K", "user", "Hi."), ("K", "assistant", "Yes.")]
    gone = [(9, t, "user", "Hi.") for t in range(400) if crc32(f"9:{t}".encode()) % 20 == 0][:1]
    assert found(C.digest(spark.createDataFrame(gone, SCHEMA))) == {9: (0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())}


def test_repair_rerole_and_insert(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "One."), (1, 2, "user", "Two."), (2, 0, "assistant", "Alone."), (3, 0, "tool", "No end")]
    report, turns = C.repair(spark.createDataFrame(rows, SCHEMA))
    assert {r.conv_id: (r.cost, r.audit, r.illegal) for r in report.collect()} == {1: (1, "KKR", 1), 2: (2, "D", 0), 3: (2, "D", 0)}
    assert [(r.role, r.text) for r in turns.where("conv_id = 1").orderBy("chunk", "place").collect()] == [("system", "Be kind."), ("user", "One."), ("assistant", "Two.")]
