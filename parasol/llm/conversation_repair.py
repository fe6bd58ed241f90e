"""Repair of the role order of conversations at least cost, by a rank-compressed dynamic programme.

A repaired conversation has the role initials ``(s?(ua)+)?``. An edit of a turn,
with the insertions before it, is one macro edit: one of nine codes of which none
is the beginning of another. So the audits (codes so far) of two states after
the same turn compare alike whatever follows, and the programme keeps no strings:
a state has its cost and the rank of its audit among the four states of its
layer, and points back to its parent. The cheapest audit, of equally cheap ones
the least, is rebuilt from the pointers afterwards.

Costs and ranks of a layer, less the least cost, take few values, so a step is
looked up. A conversation of any length is cut into blocks: what a block does to
each state is a small table, the tables are joined in order, and each block is
then rebuilt from the states that it lies between.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from parasol.llm.bpe import Cache
from parasol.llm.common import attach
from parasol.session import save_table, small_batches

#: Conversations with more rows or characters are cut into blocks of BLOCK rows at most; BLOCK is a power of two.
LONG_ROWS, LONG_CHARS, BLOCK = 5_000, 4 << 20, 512
#: Costs of edits.
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
SPACES, STOPS = " \t\n\x0b\x0c\r", ".!?"

#: What has been emitted so far: nothing, a system turn, one that ends with a user turn, one that ends with an assistant turn.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The turn that an insertion or a new role makes in each state.
MADE = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Which state keeping a turn of each initial leads to.
KEPT = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
LEGAL = {"su", "ua", "au"}
#: Macro edits in ASCII order.
CODES = sorted("I" * k + e for k in range(3) for e in "DKR")
#: Kinds of turns: one that must go, or the initial and whether it is truncated.
GONE = ("gone", False)

Kind = tuple[str, bool]
Layer = tuple[tuple[int, int] | None, ...]


def moves(kind: Kind) -> list[list[tuple[int, int, int]]]:
    """For each state the macro edits of a turn: (code's place in CODES, state after it, cost)."""
    initial, truncated = kind
    out: list[list[tuple[int, int, int]]] = [[] for _ in MADE]
    for i, code in enumerate(CODES):
        for state in range(4):
            to: int | None = state
            for _ in code[1:]:
                to = MADE[to]
            cost = INSERT * (len(code) - 1) + {"D": DELETE, "K": 0, "R": REROLE}[code[-1]]
            if code[-1] != "D":
                if kind == GONE:
                    continue
                cost += TRUNCATED * truncated
                to = MADE[to] if code[-1] == "R" else KEPT.get(initial, {}).get(to)
            if to is not None:
                out[state].append((i, to, cost))
    return out


MOVES = Cache(moves)


def step(layer_kind: tuple[Layer, Kind]) -> tuple[Layer, int, tuple]:
    """The next layer, its least cost (which is taken off) and, for each of its states, the parent and the code."""
    layer, kind = layer_kind
    best: list[tuple | None] = [None] * 4
    for state, at in enumerate(layer):
        if at:
            for i, to, cost in MOVES[kind][state]:
                tried = at[0] + cost, at[1], i, state
                if best[to] is None or tried < best[to]:
                    best[to] = tried
    return (*ranked(best, lambda b: b[1:3]), tuple(b and (b[3], CODES[b[2]]) for b in best))


def ranked(best: list[tuple | None], audit) -> tuple[Layer, int]:
    """A layer from the best candidates (cost first): costs less the least, and ranks by ``audit``."""
    low = min(b[0] for b in best if b)
    order = sorted((audit(b), s) for s, b in enumerate(best) if b)
    rank = {s: r for r, (_, s) in enumerate(order)}
    return tuple(b and (b[0] - low, rank[s]) for s, b in enumerate(best)), low


STEP = Cache(step)


def forward(runs: list[tuple[Kind, int]], entry: int) -> tuple[Layer, int, list]:
    """The last layer, its least cost and the pointers on the way, for (kind, how many) from state ``entry`` on."""
    layer: Layer = tuple((0, 0) if s == entry else None for s in range(4))
    total, path = 0, []
    for i, (kind, count) in enumerate(runs):
        while count:
            after, low, back = STEP[layer, kind]
            n = count if after == layer else 1
            path.append((back, n, i))
            layer, total, count = after, total + n * low, count - n
    return layer, total, path


def backward(path: list, state: int) -> list[tuple[int, str]]:
    """(place in runs, codes) in order, from the pointers of ``forward`` and the state at the end."""
    out = []
    for back, n, i in reversed(path):
        while n:
            parent, code = back[state]
            m = n if parent == state else 1
            out.append((i, code * m))
            state, n = parent, n - m
    return out[::-1]


def ending(layer: Layer) -> tuple[int, str, int]:
    """The state that the cheapest audit ends in, the insertions after it, and its cost in ``layer``."""
    tail = {NOTHING: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
    cost, _, state = min((at[0] + INSERT * len(tail[s]), at[1], s) for s, at in enumerate(layer) if at)
    return state, tail[state], cost


def rebuilt(codes: list[tuple[int, str]], turns: list[tuple[str, str]], entry: int) -> Iterator[str]:
    """The repaired ``role:text`` lines; ``turns`` are the (role, text) that places in ``codes`` name."""
    state = entry
    for i, code in codes:
        for edit in code:
            if edit == "K":
                role, text = turns[i]
                state = KEPT[role[0]][state]
                yield f"{role}:{text}"
            elif edit != "D":
                state = MADE[state]
                yield f"{ROLE[state]}:{turns[i][1] if edit == 'R' else ''}"


def runs_of(fault: int, initial: str, copies: int, first: bool) -> list[tuple[Kind, int]]:
    """The kinds of equal adjacent rows; ``fault``: 0 none, 1 blank, 2 truncated; ``first``: no equal row lies before."""
    if fault == 1 or not first:
        return [(GONE, copies)]
    return [((initial, fault == 2), 1)] + ([(GONE, copies - 1)] if copies > 1 else [])


def tally(rows: list[tuple[int, str, int, bool]]) -> list[int]:
    """blank, duplicate, truncated and illegal of rows (fault, initial, copies, first)."""
    blank = duplicate = truncated = illegal = 0
    before = None
    for fault, initial, copies, first in rows:
        if fault == 1:
            blank += copies
        else:
            duplicate += copies - first
            truncated += first and fault == 2
        illegal += copies - 1 + (before is not None and before + initial not in LEGAL)
        before = initial
    return [blank, duplicate, truncated, illegal]


def repair(rows: list[tuple]) -> tuple[list[int], str, str]:
    """One conversation as rows (turn, role, text, fault, copies) in order: gaps and counts and cost, audit, hash."""
    seen: set = set()
    marked, runs, turns = [], [], []
    for _, role, text, fault, copies in rows:
        first = (role, text) not in seen
        seen.add((role, text))
        marked.append((fault, role[:1], copies, first))
        for run in runs_of(fault, role[:1], copies, first):
            runs.append(run)
            turns.append((role, text))
    known = {r[0] for r in rows} - {None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    layer, cost, path = forward(runs, NOTHING)
    state, tail, more = ending(layer)
    codes = [*backward(path, state), (0, tail)]
    digest = hashlib.sha256("\n".join(rebuilt(codes, turns, NOTHING)).encode()).hexdigest()
    return [gaps, *tally(marked), cost + more], "".join(c for _, c in codes), digest


def damage(conversations: DataFrame) -> DataFrame:
    """The rows after damage: key (of the conversation), turn, role, text, fault, copies; dropped ones have no copies.

    ``key`` is "=" and the id as text, or empty for the null id.
    """
    h = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    text = F.coalesce("text", F.lit(" "))
    rows = conversations.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("key"),
        F.col("turn").cast("long").alias("turn"),
        F.when(h == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(h == 1, "").when(h == 2, F.translate(text, STOPS, "")).otherwise(text).alias("text"),
        F.when(h == 0, 0).when(h == 3, 2).otherwise(1).alias("copies"),
    )
    return rows.select("key", "turn", "role", "text", _fault(F.col("text")).alias("fault"), "copies")


def _fault(text: Column) -> Column:
    last = F.right(F.rtrim(text, F.lit(SPACES)), F.lit(1))
    return F.when(last == "", 1).when(~last.isin(*STOPS), 2).otherwise(0)


#: The order of rows; nulls come first.
ORDER = ["key", "turn", "role", "text"]
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
RESULT = f"key string, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string"


def _rows(batches) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _batches(rows, schema: str, many: int = 500):
    """Arrow batches of ``rows`` (tuples) with the columns of ``schema``, which names longs, strings and lists of longs."""
    of = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    fields = [(n, of[k]) for n, k in (f.split() for f in schema.split(", "))]
    held: list[tuple] = []

    def made():
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], k) for i, (_, k) in enumerate(fields)], [n for n, _ in fields])

    for r in rows:
        held.append(r)
        if len(held) >= many:
            yield made()
            held = []
    if held:
        yield made()


def _short(rows: DataFrame) -> DataFrame:
    """Repairs conversations that a task can hold."""

    def run(batches):
        def each():
            for key, some in groupby(_rows(batches), itemgetter(0)):
                counts, audit, digest = repair([r[1:] for r in some])
                yield (key, *counts, audit, digest)

        return _batches(each(), RESULT)

    dealt = rows.repartition("key").sortWithinPartitions(*ORDER)
    return dealt.select("key", "turn", "role", "text", "fault", "copies").mapInArrow(run, RESULT)


#: What a block says: its first and last row's initials, what it counts, and cost (-1: none) and rank for each entry and exit.
BLOCKS = "key string, block long, head string, last string, blank long, duplicate long, truncated long, illegal long, table array<long>"
CHOICES = "key string, block long, entry long, exit long, tail string, cost long, illegal long"
PARTS = "key string, block long, audit string, repaired string, lines long"


def block_table(runs: list[tuple[Kind, int]]) -> list[int]:
    """Cost and rank of each exit for each entry, in a row."""
    out = []
    for entry in range(4):
        layer, total, _ = forward(runs, entry)
        for at in layer:
            out += [at[0] + total, at[1]] if at else [-1, -1]
    return out


def chosen(tables: list[tuple[str, str, list[int]]]) -> list[tuple[int, int, str, int, int]]:
    """For the blocks (head, last, table) of a conversation, in order: entry, exit, tail; the cost on the first; illegal seams."""
    layer: Layer = ((0, 0), None, None, None)
    total, backs = 0, []
    for _, _, table in tables:
        best: list[tuple | None] = [None] * 4
        for entry, at in enumerate(layer):
            for to in range(4) if at else ():
                cost, rank = table[8 * entry + 2 * to : 8 * entry + 2 * to + 2]
                if cost >= 0:
                    tried = at[0] + cost, at[1], rank, entry
                    if best[to] is None or tried < best[to]:
                        best[to] = tried
        layer, low = ranked(best, lambda b: b[1:3])
        total += low
        backs.append([b and b[3] for b in best])
    state, tail, more = ending(layer)
    out = []
    for i in range(len(tables) - 1, -1, -1):
        seam = int(i > 0 and tables[i - 1][1] + tables[i][0] not in LEGAL)
        out.append((backs[i][state], state, tail if i == len(tables) - 1 else "", 0 if i else total + more, seam))
        state = backs[i][state]
    return out[::-1]


def _long(rows: DataFrame) -> DataFrame:
    """Repairs conversations of any length in blocks: no task holds more than a block's rows, four numbers a block and one audit."""
    equal = rows.groupBy("key", "turn", "role", "text", "fault").agg(F.sum("copies").alias("copies"))
    ordered = equal.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    ordered = save_table(ordered.withColumn("place", F.monotonically_increasing_id()), "repair-rows")
    # Equal texts of a conversation may be most of it: the first is found by partial minima and named by its place, which is its own.
    said = ordered.where("fault <> 1").groupBy("key", "role", F.sha2(F.col("text").cast("binary"), 256).alias("text_hash")).agg(F.min("place").alias("place"))
    firsts = said.select("place", F.lit(1).alias("first"))
    block = F.shiftright("place", BLOCK.bit_length() - 1).alias("block")
    marked = ordered.join(firsts, "place", "left").select("key", block, "place", "role", "text", "fault", "copies", F.coalesce("first", F.lit(0)).alias("first"))
    marked = save_table(marked, "repair-marked")

    def summed(batches):
        def each():
            for (key, block), some in groupby(_rows(batches), itemgetter(0, 1)):
                rows = [(fault, initial, copies, bool(first)) for _, _, initial, fault, copies, first in some]
                runs = [run for r in rows for run in runs_of(*r)]
                yield key, block, rows[0][1], rows[-1][1], *tally(rows), block_table(runs)

        return _batches(each(), BLOCKS)

    dealt = marked.repartition("key", "block").sortWithinPartitions("key", "block", "place")
    blocks = save_table(dealt.select("key", "block", F.left("role", F.lit(1)).alias("initial"), "fault", "copies", "first").mapInArrow(summed, BLOCKS), "repair-blocks")

    def choose(batches):
        def each():
            for key, some in groupby(_rows(batches), itemgetter(0)):
                tables = list(some)
                for t, choice in zip(tables, chosen([t[2:] for t in tables]), strict=True):
                    yield key, t[1], *choice

        return _batches(each(), CHOICES)

    in_order = blocks.repartition("key").sortWithinPartitions("key", "block")
    choices = save_table(in_order.select("key", "block", "head", "last", "table").mapInArrow(choose, CHOICES), "repair-choices")

    def rebuild(batches):
        def each():
            for (key, block), some in groupby(_rows(batches), itemgetter(0, 1)):
                runs, turns = [], []
                for _, _, role, text, fault, copies, first, entry, last, tail in some:
                    for run in runs_of(fault, role[:1], copies, bool(first)):
                        runs.append(run)
                        turns.append((role, text))
                codes = [*backward(forward(runs, entry)[2], last), (0, tail)]
                lines = list(rebuilt(codes, turns, entry))
                yield key, block, "".join(c for _, c in codes), "\n".join(lines), len(lines)

        return _batches(each(), PARTS, 8)

    with_choice = marked.join(choices.select("key", "block", "entry", "exit", "tail"), ["key", "block"])
    with_choice = with_choice.repartition("key", "block").sortWithinPartitions("key", "block", "place")
    parts = save_table(with_choice.select("key", "block", "role", "text", "fault", "copies", "first", "entry", "exit", "tail").mapInArrow(rebuild, PARTS), "repair-parts")

    def join_up(batches):
        def each():
            for key, some in groupby(_rows(batches), itemgetter(0)):
                audit, digest, begun = [], hashlib.sha256(), False
                for _, _, piece, repaired, lines in some:
                    audit.append(piece)
                    if lines:
                        digest.update((("\n" if begun else "") + repaired).encode())
                        begun = True
                yield key, "".join(audit), digest.hexdigest()

        return _batches(each(), "key string, audit string, repaired_sha256 string")

    strings = parts.repartition("key").sortWithinPartitions("key", "block").mapInArrow(join_up, "key string, audit string, repaired_sha256 string")
    turns = ordered.where("turn is not null").groupBy("key", "turn").agg(F.count("*")).groupBy("key")
    gaps = turns.agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    counts = blocks.groupBy("key").agg(*(F.sum(c).alias(c) for c in COUNTS[1:4]), F.sum("illegal").alias("inside"))
    totals = choices.groupBy("key").agg(F.sum("cost").alias("cost"), F.sum("illegal").alias("seams"))
    joined = strings.join(counts, "key").join(totals, "key").join(gaps, "key", "left")
    own = {"gaps": F.coalesce("gaps", F.lit(0)), "illegal": F.col("inside") + F.col("seams")}
    return joined.select("key", *(own.get(c, F.col(c)).cast("long").alias(c) for c in COUNTS), "audit", "repaired_sha256")


def repair_conversations(conversations: DataFrame, long_rows: int = LONG_ROWS, long_chars: int = LONG_CHARS) -> DataFrame:
    """Damages ``conversations`` (conv_id, turn, role, text) and repairs them; one row for each conv_id, the null one too.

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256. Nulls count as one space in checksums, roles and texts; a
    null turn sorts first and is no turn for ``gaps``. Rows of one turn, other
    than copies, are taken by role and text. Conversations without rows after
    damage have zeros, an empty audit and the hash of the empty string; an empty
    table gives an empty result; other columns are ignored.

    Conversations of more than ``long_rows`` rows or ``long_chars`` characters
    are repaired in blocks, the others whole in the task that they are sent to;
    the results are the same. The hash of a long one is a sequential function of
    its texts, which one task streams through.
    """
    small_batches(conversations.sparkSession)
    rows = damage(conversations)
    sizes = rows.groupBy("key").agg(F.sum("copies").alias("n"), F.sum(F.col("copies") * F.length("text")).alias("chars"))
    sizes = save_table(sizes, "repair-sizes")
    kept = rows.where("copies > 0")
    long = sizes.where((F.col("n") > long_rows) | (F.col("chars") > long_chars)).select("key", "n")
    if long.isEmpty():
        done = _short(kept)
    else:
        total = sizes.agg(F.sum("n")).first()[0]
        split = attach(kept, long, ["key"], "n", total)
        done = _short(split.where("n is null")).unionByName(_long(split.where("n is not null").drop("n")))
    nothing = [F.lit(0).cast("long").alias(c) for c in COUNTS]
    empty = sizes.where("n = 0").select("key", *nothing, F.lit("").alias("audit"), F.sha2(F.lit("").cast("binary"), 256).alias("repaired_sha256"))
    conv_id = F.when(F.col("key") != "", F.substr("key", F.lit(2))).cast(conversations.schema["conv_id"].dataType)
    return done.unionByName(empty).select(conv_id.alias("conv_id"), *COUNTS, "audit", "repaired_sha256")
