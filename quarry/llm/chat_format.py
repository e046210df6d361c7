"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns
in alternation, the last one by the assistant.  Each input turn may be kept,
given another role, merged into the turn before it, or preceded by empty turns;
a dynamic programme over the automaton of legal turns finds the cheapest
sequence (``COST``), and the repaired sequence is rendered.

A turn acts on the states as a small matrix of costs, and such matrices
multiply (minimum of sums).  A conversation of any length is therefore cut
into the range partitions its turns fall in: every part is reduced to one
matrix, the few matrices of a conversation give each part's first and last
state, and the parts are then repaired and rendered on their own.

The result has a row for each input turn with the piece of the rendered
conversation that it adds; the pieces of a conversation, in order, are its
rendering, and no task has to hold a long one whole.

Results: turns are ordered by ``turn`` (nulls last), then role, text and
position; a null role is a role to be replaced; a null text is empty; null
conversation ids form one conversation; repeated rows are turns of their own;
an empty table gives an empty result.
"""

from __future__ import annotations

import itertools

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._common import prepare, shuffle_width
from quarry.session import cut_lineage

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
#: (state, role) -> state
LEGAL = {(START, "system"): SYSTEM, (START, "user"): USER, (SYSTEM, "user"): USER,
         (USER, "assistant"): ASSISTANT, (ASSISTANT, "user"): USER}
ROLE_OF = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
COST = {"relabel": 3, "merge": 1, "insert": 2}
FAR = 1 << 40
# Other names of the roles.
ALIASES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

END = "\n<|end|>\n"


def role_name(role: str | None) -> str:
    r = (role or "").strip().lower()
    return ALIASES.get(r, r)


def _fillers(state: int, role: str) -> list[str] | None:
    """The empty turns that make ``role`` legal after ``state``."""
    for n in range(3):
        for roles in itertools.product(("user", "assistant"), repeat=n):
            s: int | None = state
            for r in (*roles, role):
                s = LEGAL.get((s, r)) if s is not None else None
            if s is not None:
                return list(roles)
    return None


def moves(role: str) -> dict[tuple[int, int], tuple[int, int, str, str, tuple[str, ...]]]:
    """(state, next state) -> cheapest (cost, turns added, action, role, empty
    turns before); among equal costs the first in the order keep, merge,
    relabel, merge and relabel, with fewer insertions first."""
    best: dict = {}

    def offer(s, t, cost, added, action, label, fill):
        if (s, t) not in best or cost < best[s, t][0]:
            best[s, t] = (cost, added, action, label, tuple(fill))

    for s in STATES:
        labels = sorted(ROLES, key=lambda r: r != role)
        for label in labels:
            fill = _fillers(s, label)
            if fill is not None:
                end = s
                for r in (*fill, label):
                    end = LEGAL[end, r]
                action = ("keep" if label == role else "relabel") + ("+insert" if fill else "")
                offer(s, end, COST["insert"] * len(fill) + COST["relabel"] * (label != role), len(fill) + 1, action, label, fill)
        if s != START:
            same = ROLE_OF[s] == role
            offer(s, s, COST["merge"] + COST["relabel"] * (not same), 0, "merge" if same else "relabel+merge", ROLE_OF[s], ())
    return best


MOVES = {r: moves(r) for r in (*ROLES, "other")}
#: Empty turns that end a conversation legally.
ENDINGS = {START: ("user", "assistant"), SYSTEM: ("user", "assistant"), USER: ("assistant",), ASSISTANT: ()}


def walk(roles: list[str], entry: int):
    """Forward pass from one state: the costs and the numbers of added turns
    by state, and per turn the state each state was best reached from."""
    cost = {s: FAR for s in STATES} | {entry: 0}
    added = dict.fromkeys(STATES, 0)
    back = []
    for role in roles:
        nxt, n, came = {s: FAR for s in STATES}, dict.fromkeys(STATES, 0), {}
        for (s, t), m in MOVES[role if role in MOVES else "other"].items():
            if cost[s] + m[0] < nxt[t]:
                nxt[t], n[t], came[t] = cost[s] + m[0], added[s] + m[1], s
        cost, added = nxt, n
        back.append(came)
    return cost, added, back


def path(roles: list[str], entry: int, last: int) -> list[tuple]:
    """The moves of the cheapest way from ``entry`` to ``last``."""
    back = walk(roles, entry)[2]
    out, state = [], last
    for role, came in zip(reversed(roles), reversed(back), strict=True):
        before = came[state]
        out.append(MOVES[role if role in MOVES else "other"][before, state])
        state = before
    return out[::-1]


def chain(parts: list[tuple[list[int], list[int]]]) -> list[tuple[int, int, int]]:
    """Per part of one conversation its first state, last state and the number
    of turns before it, from the parts' matrices (16 costs, 16 counts)."""
    costs = [{s: FAR for s in STATES} | {START: 0}]
    backs = []
    for matrix, _ in parts:
        nxt, came = {s: FAR for s in STATES}, {}
        for s in STATES:
            for t in STATES:
                c = costs[-1][s] + matrix[4 * s + t]
                if c < nxt[t]:
                    nxt[t], came[t] = c, s
        costs.append(nxt)
        backs.append(came)
    state = min(STATES, key=lambda s: (costs[-1][s] + COST["insert"] * len(ENDINGS[s]), -s))
    states = [state]
    for came in reversed(backs):
        state = came[state]
        states.append(state)
    states.reverse()
    out, before = [], 0
    for k, (_, counts) in enumerate(parts):
        out.append((states[k], states[k + 1], before))
        before += counts[4 * states[k] + states[k + 1]]
    return out


def _escape(text: str | None) -> str:
    """Text cannot forge a mark."""
    return (text or "").replace("<|", "<\\|")


def render(move: tuple, text: str | None, first: bool) -> str:
    """What a turn adds to the rendering; the turn before it is still open."""
    _, added, _, role, fill = move
    if not added:
        return "\n" + _escape(text)
    turns = [f"<|{r}|>\n" for r in (*fill, role)]
    return ("" if first else END) + END.join(turns) + _escape(text)


def closing(state: int) -> str:
    return END + "".join(f"<|{r}|>\n{END}" for r in ENDINGS[state])


def _runs(batches, columns: list[str]):
    """Rows in order, grouped by conversation and part."""
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in columns), strict=True))
    return itertools.groupby(rows, key=lambda r: (r[0], r[1]))


def _emit(rows: list, types: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(types)],
                                      names=[n for n, _ in types])


def _in_runs(df: DataFrame) -> DataFrame:
    return df.repartition(shuffle_width(df), "conv", "part").sortWithinPartitions("conv", "part", "nth")


def format_chats(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """``conv_id, turn, position, role_in, role_out, action, inserted, cost,
    out_turn, rendered``: one row per input turn; ``position`` counts a
    conversation's rows from 0 within a part of it, ``part`` the parts."""
    spark = turns.sparkSession
    prepare(spark)
    src = cut_lineage(turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
                                   F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
                      .withColumn("uid", F.monotonically_increasing_id()))
    order = [F.asc_nulls_last("conv"), F.asc_nulls_last("turn"), F.asc_nulls_first("role"), F.xxhash64("text"), F.asc("uid")]
    # parts are written, so every later step sees the same ones
    ranged = src.repartitionByRange(shuffle_width(turns), *order).sortWithinPartitions(*order)
    ranged = cut_lineage(ranged.drop("uid").withColumn("nth", F.monotonically_increasing_id()))
    parts = ranged.withColumn("part", F.shiftright("nth", 33))
    conv_type = src.schema["conv"].dataType
    turn_type = src.schema["turn"].dataType

    def matrices(batches):
        out, types = [], None
        batches = iter(batches)
        head = next(batches, None)
        if head is None:
            return
        types = [("conv", head.schema.field("conv").type), ("part", pa.int64()), ("costs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))]
        for (conv, part), rows in _runs(itertools.chain([head], batches), ["conv", "part", "role"]):
            roles = [role_name(r[2]) for r in rows]
            walks = [walk(roles, s) for s in STATES]
            out.append((conv, part, [w[0][t] for w in walks for t in STATES], [w[1][t] for w in walks for t in STATES]))
            if len(out) >= 5000:
                yield _emit(out, types)
                out = []
        if out:
            yield _emit(out, types)

    def states(batches):
        for b in batches:
            rows = []
            for conv, items in zip(b.column("conv").to_pylist(), b.column("items").to_pylist(), strict=True):
                found = chain([(i["costs"], i["counts"]) for i in items])
                rows += [(conv, i["part"], *f, k == len(items) - 1) for k, (i, f) in enumerate(zip(items, found, strict=True))]
            yield _emit(rows, [("conv", b.schema.field("conv").type), ("part", pa.int64()), ("entry", pa.int32()),
                               ("leave", pa.int32()), ("before", pa.int64()), ("final", pa.bool_())])

    conv_sql = conv_type.simpleString()
    matrix = _in_runs(parts.select("conv", "part", "nth", "role")).mapInArrow(
        matrices, f"conv {conv_sql}, part long, costs array<long>, counts array<long>")
    # a conversation has at most as many parts as there are partitions
    per_conv = matrix.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("part", "costs", "counts"))).alias("items"))
    known = cut_lineage(per_conv.mapInArrow(states, f"conv {conv_sql}, part long, entry int, leave int, before long, final boolean"))

    k = known.withColumnsRenamed({"conv": "k_conv", "part": "k_part"})
    joined = parts.join(k, parts["conv"].eqNullSafe(k["k_conv"]) & (parts["part"] == k["k_part"])).drop("k_conv", "k_part")

    def repair(batches):
        out = []
        batches = iter(batches)
        head = next(batches, None)
        if head is None:
            return
        types = [("conv_id", head.schema.field("conv").type), ("turn", head.schema.field("turn").type), ("part", pa.int64()),
                 ("position", pa.int64()), ("role_in", pa.string()), ("role_out", pa.string()), ("action", pa.string()),
                 ("inserted", pa.int32()), ("cost", pa.int32()), ("out_turn", pa.int64()), ("rendered", pa.string())]
        columns = ["conv", "part", "turn", "role", "text", "entry", "leave", "before", "final"]
        size = 0
        for (conv, part), group in _runs(itertools.chain([head], batches), columns):
            rows = list(group)
            entry, leave, at, final = rows[0][5:]
            for n, (r, m) in enumerate(zip(rows, path([role_name(r[3]) for r in rows], entry, leave), strict=True)):
                piece = render(m, r[4], at == 0)
                at += m[1]
                end = final and n == len(rows) - 1
                cost, inserted = m[0], len(m[4])
                if end:
                    piece += closing(leave)
                    cost, inserted = cost + COST["insert"] * len(ENDINGS[leave]), inserted + len(ENDINGS[leave])
                out.append((conv, r[2], part, n, r[3], m[3], m[2], inserted, cost, at - 1, piece))
                size += len(piece)
                if size > 4 << 20 or len(out) >= 5000:
                    yield _emit(out, types)
                    out, size = [], 0
        if out:
            yield _emit(out, types)

    return _in_runs(joined).mapInArrow(
        repair, f"conv_id {conv_sql}, turn {turn_type.simpleString()}, part long, position long, role_in string, "
                "role_out string, action string, inserted int, cost int, out_turn long, rendered string")


def whole_renderings(formatted: DataFrame) -> DataFrame:
    """``conv_id, rendered, cost``: the pieces put together, for conversations
    that fit one row."""
    return formatted.groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "position", "rendered"))), lambda x: x["rendered"]), "")
        .alias("rendered"), F.sum("cost").alias("cost"))
