"""Conversation repair against exhaustive search and its SQL."""

import hashlib
import heapq
import random
import re

import duckdb
import pandas as pd
import pytest

from barloom.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """(cost, audit, lines) by search over whole edit sequences, least first."""
    seen, faults = set(), []
    for role, text in rows:
        if not re.search(r"[^\x20\x09-\x0D]", text):
            faults.append("gone")
        elif (role, text) in seen:
            faults.append("gone")
        else:
            faults.append("" if re.search(r"[.!?][\x20\x09-\x0D]*\Z", text) else "cut")
        seen.add((role, text))
    heap = [(0, "", 0, "", ())]
    while heap:
        cost, edits, i, shape, lines = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", shape):
            return cost, edits, lines
        if len(edits) > 2 * len(rows) + 3 or not re.fullmatch("s?(ua)*u?", shape):
            continue
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 3, edits + "I", i, shape + role[0], (*lines, role + ":")))
        if i < len(rows):
            (role, text), more = rows[i], 3 * (faults[i] == "cut")
            heapq.heappush(heap, (cost + 4, edits + "D", i + 1, shape, lines))
            if faults[i] != "gone":
                if role:  # a row without a role has no initial to keep
                    heapq.heappush(heap, (cost + more, edits + "K", i + 1, shape + role[:1], (*lines, f"{role}:{text}")))
                for to in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 3 + more, edits + "R", i + 1, shape + to[0], (*lines, f"{to}:{text}")))
    return None


@pytest.fixture(scope="module")
def conversations():
    rng = random.Random(5)
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 6)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = rng.choice(["a.", "b", "c!", "d?\n", " ", "", None, "e. f", "été.", "x\u0085"])
            rows.append((conv, rng.choice([turn, turn, turn + 2, None]), role, text))
    rows += [(None, 1, "user", "no id."), (None, None, None, None), (7, 1, "user", "tie."), (7, 1, "assistant", "tie.")]
    return rows


def test_like_search(spark, conversations):
    frame = spark.createDataFrame(conversations, SCHEMA)
    got = {r.conv_id: r for r in repair.audit(frame).collect()}
    edits = {}
    for r in repair.repair(frame).orderBy("conv_id", "seq").collect():
        edits.setdefault(r.conv_id, []).append(r)
    by_conv = {}
    for conv, turn, role, text in conversations:
        role, text = " " if role is None else role, " " if text is None else text
        by_conv.setdefault(conv, []).append((turn is not None, turn or 0, role, text))
    assert set(got) == set(by_conv)
    for conv, rows in by_conv.items():
        cost, audit, lines = cheapest([r[2:] for r in sorted(rows)])
        assert (got[conv].cost, got[conv].audit) == (cost, audit), rows
        assert got[conv].repaired_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()
        assert "".join(e.edit for e in edits[conv]) == audit
        assert tuple(f"{e.role}:{e.text}" for e in edits[conv] if e.edit != "D") == lines


def test_query_like_sql(spark, conversations, tmp_path):
    frame = spark.createDataFrame(conversations * 2, SCHEMA).selectExpr("*", "1 AS fault", "2 AS seen", "3 AS kind")
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    pandas = frame.toPandas()
    con.register("conversations", pandas.assign(turn=pandas.turn.astype("Int64"), conv_id=pandas.conv_id.astype("Int64")))
    want = con.execute(repair.SQL_REPAIR).fetchdf()
    got = repair.op13_repair(spark, str(tmp_path)).toPandas()[list(want.columns)]
    got, want = (f.assign(conv_id=f.conv_id.astype("Int64")) for f in (got, want))

    def rows(f: pd.DataFrame):
        return sorted(map(str, f.astype(object).where(f.notna(), None).itertuples(index=False, name=None)))

    assert rows(got) == rows(want)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.repair(none).count() == repair.audit(none).count() == 0


def test_open_part_stays_small():
    """A sound conversation is written as it is read; its texts aren't kept."""
    written = []
    viterbi = repair.Viterbi(lambda *e: written.append(e), {})
    for i in range(20_000):
        viterbi.add(("user" if i % 2 == 0 else "assistant", str(i)), "ua"[i % 2], False, False)
        assert len(written) >= i - 4
    assert viterbi.finish() == 0
    assert "".join(e[0] for e in written) == "K" * 20_000


def test_ties_stay_open_and_right():
    """User rows only: alternating repairs tie all along, so nothing is final before the end."""
    for n in range(1, 9):
        rows = [("user", f"{i}.") for i in range(n)]
        written = []
        viterbi = repair.Viterbi(lambda *e: written.append(e), {})
        for row in rows:
            viterbi.add(row, "u", False, False)
        cost = viterbi.finish()
        assert (cost, "".join(e[0] for e in written)) == cheapest(rows)[:2]
