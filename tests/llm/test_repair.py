"""Conversation repair against a plain programme on whole strings, and against all edits of small conversations."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings, strategies as st

from parasol.llm import conversation_repair as repair_module
from parasol.llm.conversation_repair import NOTHING, block_table, chosen, forward, repair, repair_conversations, runs_of
from tests.llm.helpers import clashing

SHAPE = re.compile("(s?(ua)+)?")
SPACE = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    """rows (conv, turn, role, text) -> {conv: rows (turn, role, text)}, every conv."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        out[conv] += []
        if h == 0:
            continue
        if h == 1:
            text = ""
        if h == 2:
            text = re.sub("[.!?]", "", text)
        if h == 4:
            role = "user"
        out[conv] += [(turn, role, text)] * (2 if h == 3 else 1)
    for some in out.values():
        some.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        if not text.strip(SPACE):
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        elif text.rstrip(SPACE)[-1] not in ".!?":
            out.append("truncated")
        else:
            out.append("")
        seen.add((role, text))
    return out


def plain_repair(rows):
    """Best suffixes, as whole strings, from each row and what was emitted so far."""
    fault = faults(rows)
    best = {}

    def next_role(last):
        return "assistant" if last == "u" else "user"

    def solve(i, last, run):
        """(cost, audit, lines) from row ``i`` on, after an initial ``last`` ("" none) and ``run`` insertions."""
        if (i, last, run) in best:
            return best[i, last, run]
        tried = []
        if i == len(rows) and last in ("", "a"):
            tried.append((0, "", ()))
        if run < 2:
            cost, audit, lines = solve(i, next_role(last)[0], run + 1)
            tried.append((cost + 3, "I" + audit, (f"{next_role(last)}:", *lines)))
        if i < len(rows):
            _, role, text = rows[i]
            cost, audit, lines = solve(i + 1, last, 0)
            tried.append((cost + 4, "D" + audit, lines))
            if fault[i] not in ("blank", "duplicate"):
                more = 3 if fault[i] == "truncated" else 0
                legal = {"s": last == "", "u": last != "u", "a": last == "u"}
                if legal.get(role[:1]):
                    cost, audit, lines = solve(i + 1, role[:1], 0)
                    tried.append((cost + more, "K" + audit, (f"{role}:{text}", *lines)))
                cost, audit, lines = solve(i + 1, next_role(last)[0], 0)
                tried.append((cost + 3 + more, "R" + audit, (f"{next_role(last)}:{text}", *lines)))
        best[i, last, run] = min(tried, key=lambda t: t[:2]) if tried else (10**9, "", ())
        return best[i, last, run]

    for i in range(len(rows), -1, -1):
        for last in ("", "s", "u", "a"):
            solve(i, last, 0)
    cost, audit, lines = best[0, "", 0]
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    turns = {r[0] for r in rows} - {None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    count = [fault.count(k) for k in ("blank", "duplicate", "truncated")]
    return (gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def all_edits(rows):
    """Cost and audit of the best of all edits with two insertions at most at each place."""
    fault, best = faults(rows), None
    gaps = [("", "I", "II")] * (len(rows) + 1)
    for edits in itertools.product("DKR", repeat=len(rows)):
        if any(e != "D" and f in ("blank", "duplicate") for e, f in zip(edits, fault, strict=True)):
            continue
        for runs in itertools.product(*gaps):
            shape, cost, audit = "", 0, ""
            for i in range(len(rows) + 1):
                for e in runs[i] + (edits[i] if i < len(rows) else ""):
                    audit += e
                    new = "a" if shape[-1:] == "u" else "u"
                    cost += {"I": 3, "D": 4, "R": 3, "K": 0}[e]
                    if e in "KR" and fault[i] == "truncated":
                        cost += 3
                    shape += {"I": new, "R": new, "K": (rows[i][1][:1] or "?") if e == "K" else "", "D": ""}[e]
            if SHAPE.fullmatch(shape) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


def kernel_rows(rows):
    """The rows as the operator's kernel takes them, equal neighbours as copies."""
    out = []
    for row, some in itertools.groupby(rows):
        text = row[2].rstrip(SPACE)
        out.append((*row, 1 if not text else 0 if text[-1] in ".!?" else 2, len(list(some))))
    return out


turn = st.tuples(st.integers(0, 3), st.sampled_from(["system", "user", "assistant", "tool", ""]), st.sampled_from(["", " ", "a.", "b", "c!", "d? ", "e"]))


@settings(max_examples=60, deadline=None)
@given(st.lists(turn, max_size=3))
def test_least_of_all_edits(rows):
    rows.sort()
    counts, audit, _ = repair(kernel_rows(rows))
    assert (counts[-1], audit) == all_edits(rows)


@settings(max_examples=400, deadline=None)
@given(st.lists(turn, max_size=30))
def test_kernel_equals_strings(rows):
    rows.sort()
    counts, audit, digest = repair(kernel_rows(rows))
    assert (*counts, audit, digest) == plain_repair(rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(turn, min_size=1, max_size=30), st.integers(1, 6))
def test_blocks_equal_the_whole(rows, size):
    rows.sort()
    seen, runs = set(), []
    for _, role, text, fault, copies in kernel_rows(rows):
        runs += runs_of(fault, role[:1], copies, (role, text) not in seen)
        seen.add((role, text))
    parts = [runs[i : i + size] for i in range(0, len(runs), size)]
    choices = chosen([("u", "a", block_table(p)) for p in parts])
    audit = "".join("".join(c for _, c in repair_module.backward(forward(p, c[0])[2], c[1])) + c[2] for p, c in zip(parts, choices, strict=True))
    expected = plain_repair(rows)
    assert choices[0][0] == NOTHING
    assert (sum(c[3] for c in choices), audit) == (expected[5], expected[6])


def test_many_copies_are_one_step():
    rows = [(0, "user", "a.", 0, 10**7), (1, "assistant", "b.", 0, 1)]
    counts, audit, _ = repair(rows)
    assert audit == "K" + "D" * (10**7 - 1) + "K" and counts == [0, 0, 10**7 - 1, 0, 10**7 - 1, 4 * (10**7 - 1)]


SCHEMA = "conv_id long, turn long, role string, text string"


def awkward_rows(seed=1):
    rng = random.Random(seed)
    texts = ["Hi.", "no end", "why? ", "", " ", None, "same.", "same.", "x\ny!", "é。", "...", "long " * 5000 + "."]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "tool", ""]), rng.choice(texts)) for c in range(60) for t in range(rng.choice([0, 1, 2, 5, 9]))]
    rows += [(c, None, rng.choice(["user", "assistant"]), rng.choice(texts)) for c in (1, 2, 3, None, None, 900, 900)]
    rows += [(None, t, "user", "a.") for t in range(4)] + rows[:20]
    rows += [(77, t, rng.choice(["user", "assistant"]), rng.choice(texts[:7] + [f"t{t}.", f"t{t}"])) for t in range(400)]
    rows += [(78, 5, "user", "again and again.")] * 700 + [(78, 9, "assistant", "yes")]
    return rows


def got(frame):
    return {r.conv_id: tuple(r)[1:] for r in frame.collect()}


@pytest.mark.parametrize(("long_rows", "long_chars"), [(5000, 1 << 22), (30, 1 << 22), (0, 0)])
def test_awkward_conversations(spark, monkeypatch, long_rows, long_chars):
    monkeypatch.setattr(repair_module, "BLOCK", 16)
    rows = awkward_rows()
    frame = clashing(spark.createDataFrame(rows, SCHEMA).repartition(5))
    result = repair_conversations(frame, long_rows, long_chars)
    assert result.columns == ["conv_id", *repair_module.COUNTS, "audit", "repaired_sha256"]
    damaged = plain_damage(rows)
    answers = got(result)
    assert result.count() == len(damaged)
    assert answers == {conv: plain_repair(some) for conv, some in damaged.items()}


def test_no_rows(spark):
    assert repair_conversations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_equals_the_plain_programme(spark):
    from parasol.llm.queries import op11_conversation_repair

    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(op11_conversation_repair(spark, sf_dir)) == {conv: plain_repair(some) for conv, some in plain_damage(rows).items()}
