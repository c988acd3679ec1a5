"""Repair of conversations to the turn structure `(s?(ua)+)?` at least cost, with the least audit.

The grammar has four states; a set of them is four bits. From the last row backwards, layer k holds the states from
which the rest can be accepted at cost k or less: a layer comes from those of the row after it, shifted by the cost
of keeping, turning or deleting the row, and from its own lower ones by insertions. Costs of the four states never
lie far apart, so the layers of a row are a base and a short tuple of bitsets; few such tuples exist, and the step
from one to the next is remembered. The first layer with the start state gives the cost. The audit is traced
forwards through the layers' bits: of the edits that stay on a cheapest way, the least letter is taken.

A conversation may hold any share of all rows. Rows without their texts are sorted over the cluster by conversation
and turn; what a range of that order has of a conversation is a segment. For every segment the costs from each
state to each state are found in parallel, folded into the costs that remain at its end, and then traced from each
state that it may start in; which one it does follows from a second fold over the segments. Texts are shuffled once,
for the hash of a repaired conversation, which is the one thing that has to read it in order: row by row, nothing held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm.common import CACHES, arrow_map, only, settle

SPACE = " \t\n\x0b\x0c\r"
#: Costs of edits, modulus of the damage.
TURN_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST, DAMAGE = 3, 4, 3, 3, 20
#: Signs are s, u, a and others as 0 to 3; a row's code adds 4 for truncated, 8 for blank, 12 for a duplicate.
SIGNS, TRUNCATED, BLANK, DUPLICATE = "sua", 1, 2, 3
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a. Where a sign leads, where a user or assistant leads.
MOVES = ({0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3}, {})
NEXT, ACCEPTING = (2, 2, 3, 2), (0, 3)
CLOSING = ("", "II", "I", "")  # insertions that lead from a state to acceptance
FAR = 24

Layers = tuple[int, ...]


def _before(moves: dict[int, int]) -> list[int]:
    """For each set of states those that a sign leads into it."""
    return [sum(1 << q for q, r in moves.items() if into >> r & 1) for into in range(16)]


_KEPT, _TURNED = [_before(m) for m in MOVES], _before(dict(enumerate(NEXT)))
_steps: dict[tuple[Layers, int], tuple[Layers, int]] = {}
_traces: dict[tuple[Layers, int, int], tuple[str, int, int]] = {}
CACHES += [_steps, _traces]


def step(after: Layers, code: int) -> tuple[Layers, int]:
    """Layers before a row from those after it, and how much higher their base is."""
    found = _steps.get((after, code))
    if found is None:
        sign, fault = code & 3, code >> 2
        at = lambda k: 0 if k < 0 else after[min(k, len(after) - 1)]
        own = TRUNCATED_COST if fault == TRUNCATED else 0
        out: list[int] = []
        for c in range(len(after) + FAR):
            some = at(c - DELETE_COST)
            if fault < BLANK:
                some |= _KEPT[sign][at(c - own)] | _TURNED[at(c - own - TURN_COST)]
            if c >= INSERT_COST:
                some |= _TURNED[out[c - INSERT_COST]]
            out.append(some | (out[-1] if out else 0))
        base = next(k for k, some in enumerate(out) if some)
        end = out.index(out[-1])
        found = _steps[after, code] = tuple(out[base : end + 1]), base
    return found


def cost_of(layers: Layers, state: int) -> int | None:
    return next((k for k, some in enumerate(layers) if some >> state & 1), None)


def layers_of(costs: list[int]) -> Layers:
    """Layers of the costs that remain in each state."""
    least, most = min(costs), max(costs)
    return tuple(sum(1 << q for q, c in enumerate(costs) if c <= k) for k in range(least, most + 1))


def _trace(after: Layers, code: int, state: int) -> tuple[str, int, int]:
    """Letters up to and with this row's, the state they lead to, and what they cost."""
    found = _traces.get((after, code, state))
    if found is None:
        here, base = step(after, code)
        sign, fault = code & 3, code >> 2
        own = TRUNCATED_COST if fault == TRUNCATED else 0
        letters, q, spent = "", state, 0
        while True:
            left = cost_of(here, q) + base
            on = lambda to, cost, left=left: to is not None and cost_of(after, to) == left - cost
            if on(q, DELETE_COST):
                found = letters + "D", q, spent + DELETE_COST
            elif (k := cost_of(here, NEXT[q])) is not None and k + base == left - INSERT_COST:
                letters, q, spent = letters + "I", NEXT[q], spent + INSERT_COST
                continue
            elif fault < BLANK and on(MOVES[sign].get(q), own):
                found = letters + "K", MOVES[sign][q], spent + own
            else:
                found = letters + "R", NEXT[q], spent + own + TURN_COST
            break
        _traces[after, code, state] = found
    return found


def relation(codes: bytes) -> list[int]:
    """Least cost from each state before the rows to each after them, by 4 * before + after; -1 for none."""
    out = [-1] * 16
    for end in range(4):
        layers, total = (1 << end,), 0
        for code in reversed(codes):
            layers, more = step(layers, code)
            total += more
        for q in range(4):
            k = cost_of(layers, q)
            out[4 * q + end] = -1 if k is None else total + k
    return out


def before(rel: list[int], costs: list[int]) -> list[int]:
    """Costs that remain before a segment from those after it."""
    return [min(rel[4 * q + t] + c for t, c in enumerate(costs) if rel[4 * q + t] >= 0) for q in range(4)]


def audits(codes: bytes, costs: list[int], starts: list[int]) -> list[tuple[str, int, int]]:
    """For each start: least letters of a cheapest way when `costs` remain at the end, the state there, the cost."""
    after = [layers_of(costs)]
    for code in reversed(codes[1:]):
        after.append(step(after[-1], code)[0])
    out = []
    for state in starts:
        letters, spent = [], 0
        for code, layers in zip(codes, reversed(after), strict=True):
            part, state, cost = _trace(layers, code, state)
            letters.append(part)
            spent += cost
        out.append(("".join(letters), state, spent))
    return out


CLOSED = [INSERT_COST * len(x) for x in CLOSING]


# -- over tables --------------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies of the rows that remain, each damaged as the hash of its place says."""
    c = only(conversations, "conv_id", "turn", "role", "text")
    spaced = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % DAMAGE
    c = c.select("conv_id", F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"), what.alias("what"))
    text = F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("what") == 4, "user").otherwise(F.col("role"))
    return c.where("what <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("what") == 3, 2).otherwise(1).alias("copies"))


def _digest() -> Column:
    """Of conversation, role and text, so that equal ones are repeats."""
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null"))
    return F.unhex(F.md5(F.concat(conv, F.lit("\x00"), F.length("role").cast("string"), F.lit(":"), "role", "text")))


def _code() -> Column:
    body = F.rtrim(F.col("text"), F.lit(SPACE))
    sign = F.instr(F.lit(SIGNS), F.substring("role", 1, 1))
    sign = F.when((F.col("role") == "") | (sign == 0), 3).otherwise(sign - 1)
    fault = F.when(body == "", BLANK).when(~F.right(body, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    return (sign + 4 * fault).cast("int")


def _marked(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, code, pos: all rows in order over the cluster, later equal ones as duplicates."""
    keys = rows.select("conv_id", "turn", "role", _digest().alias("digest"), _code().alias("code"), F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    # equal rows may stand in any order: their number lets a crowd of them be split
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest", "salt"]
    keys = keys.withColumn("salt", F.monotonically_increasing_id())
    placed = keys.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "digest", "code", F.monotonically_increasing_id().alias("pos"))
    placed = settle(placed, "placed")
    first = placed.groupBy("digest").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    again = F.col("first").isNotNull() & (F.col("first") != F.col("pos")) & (F.col("code") < 4 * BLANK)
    return placed.join(first, "digest", "left").withColumn("code", F.when(again, F.col("code") % 4 + 4 * DUPLICATE).otherwise(F.col("code"))).drop("first")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows of one conversation and range, from rows in order."""
    conv, part, held, began = None, None, None, False

    def packed():
        codes, turns = bytes(held["codes"]), held["turns"]
        signs = [c & 3 for c in codes]
        known = [t for t in turns if t is not None]
        return {
            "conv_id": conv, "seg": held["seg"], "codes": codes, "turns": turns, "roles": held["roles"], "digests": b"".join(held["digests"]), "relation": relation(codes),
            "first_turn": known[0] if known else None, "last_turn": known[-1] if known else None, "distinct_turns": len(set(known)), "first_sign": signs[0], "last_sign": signs[-1],
            "blank": sum(c >> 2 == BLANK for c in codes), "duplicate": sum(c >> 2 == DUPLICATE for c in codes), "truncated": sum(c >> 2 == TRUNCATED for c in codes),
            "illegal": sum(not _legal(a, b) for a, b in zip(signs, signs[1:], strict=False)),
        }

    schema = None
    for batch in batches:
        if schema is None:
            kind = batch.schema.field("conv_id").type
            schema = pa.schema([("conv_id", kind), *_PIECE])
        out = []
        for c, t, r, d, code, pos in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "turn", "role", "digest", "code", "pos")), strict=True):
            if not began or c != conv or pos >> 33 != part:
                if began:
                    out.append(packed())
                conv, part, began = c, pos >> 33, True
                held = {"seg": pos, "codes": bytearray(), "turns": [], "roles": [], "digests": []}
            held["codes"].append(code)
            held["turns"].append(t)
            held["roles"].append(r)
            held["digests"].append(d)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    if began:
        yield pa.RecordBatch.from_pylist([packed()], schema=schema)


_COUNTS = ("distinct_turns", "first_sign", "last_sign", "blank", "duplicate", "truncated", "illegal")
_PIECE = [
    ("seg", pa.int64()), ("codes", pa.binary()), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("digests", pa.binary()), ("relation", pa.list_(pa.int64())),
    ("first_turn", pa.int64()), ("last_turn", pa.int64()), *((x, pa.int64()) for x in _COUNTS),
]
_PIECE_SQL = "seg long, codes binary, turns array<long>, roles array<string>, digests binary, relation array<long>, first_turn long, last_turn long, " + ", ".join(f"{x} long" for x in _COUNTS)


def _legal(a: int, b: int) -> bool:
    return (a, b) in ((0, 1), (1, 2), (2, 1))


def _costs_after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each segment of a conversation the costs that remain after it, and whether it is the first."""
    for batch in batches:
        out = []
        for segs in batch.column("segs").to_pylist():
            costs = CLOSED
            for k in range(len(segs) - 1, -1, -1):
                out.append({"seg": segs[k]["seg"], "remain": costs, "first": k == 0})
                costs = before(segs[k]["relation"], costs)
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("seg", pa.int64()), ("remain", pa.list_(pa.int64())), ("first", pa.bool_())]))


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("audit", pa.string()), ("state", pa.int64()), ("cost", pa.int64())]))
    for batch in batches:
        ways = []
        for codes, remain, first in zip(*(batch.column(x).to_pylist() for x in ("codes", "remain", "first")), strict=True):
            ways.append([dict(zip(("audit", "state", "cost"), w, strict=True)) for w in audits(codes, remain, [0] if first else [0, 1, 2, 3])])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ways, kind)], schema=batch.schema.append(pa.field("ways", kind)))


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation: its counts, and the state in which each segment starts."""
    for batch in batches:
        out = []
        for segs in batch.column("segs").to_pylist():
            state, cost, begin, entries, turns, last = 0, 0, None, [], 0, None
            total = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
            sign = None
            for s in segs:
                entries.append({"seg": s["seg"], "state": state})
                way = s["ends"][state]
                state, cost = way["state"], cost + way["cost"]
                for k in total:
                    total[k] += s[k]
                total["illegal"] += sign is not None and not _legal(sign, s["first_sign"])
                sign = s["last_sign"]
                if s["first_turn"] is not None:
                    begin = s["first_turn"] if begin is None else begin
                    turns += s["distinct_turns"] - (last == s["first_turn"])
                    last = s["last_turn"]
            gaps = 0 if begin is None else last - begin + 1 - turns
            out.append({**total, "gaps": gaps, "cost": cost + CLOSED[state], "closing": CLOSING[state], "close_state": state, "entries": entries})
        kind = pa.schema([*((x, pa.int64()) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("closing", pa.string()), ("close_state", pa.int64()), ("entries", pa.list_(pa.struct([("seg", pa.int64()), ("state", pa.int64())])))])
        made = pa.RecordBatch.from_pylist(out, schema=kind)
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *made.columns], names=["conv_id", *made.schema.names])


_ADDED = ("user:", "assistant:")  # lines of inserted rows


def _inserted(state: int, n: int) -> tuple[list[str], int]:
    lines = []
    for _ in range(n):
        state = NEXT[state]
        lines.append(_ADDED[state - 2])
    return lines, state


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each row that stays: the lines to write before it, and its role if that changes."""
    kind = None
    for batch in batches:
        kind = kind or pa.schema([("conv_id", batch.schema.field("conv_id").type), ("turn", pa.int64()), ("role", pa.string()), ("digest", pa.binary()), ("lead", pa.string()), ("as_role", pa.string())])
        names = ("conv_id", "codes", "turns", "roles", "digests", "audit", "state")
        out: list[dict] = []
        for conv, codes, turns, roles, digests, audit, state in zip(*(batch.column(x).to_pylist() for x in names), strict=True):
            at = n = 0
            for letter in audit:
                if letter == "I":
                    n += 1
                    continue
                if letter != "D":  # insertions come right before a row that stays: with a deletion between, deleting first is the lesser audit
                    lead, state = _inserted(state, n)
                    n = 0
                    kept = letter == "K"
                    state = MOVES[codes[at] & 3][state] if kept else NEXT[state]
                    out.append({"conv_id": conv, "turn": turns[at], "role": roles[at], "digest": digests[16 * at : 16 * at + 16], "lead": "".join(x + "\n" for x in lead), "as_role": None if kept else _ADDED[state - 2][:-1]})
                    if len(out) >= 2000:
                        yield pa.RecordBatch.from_pylist(out, schema=kind)
                        out = []
                at += 1
        yield pa.RecordBatch.from_pylist(out, schema=kind)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each repaired conversation, from its edits and texts in order; nothing but the hash's state is held."""
    conv, hasher, began, wanted, written = None, None, False, None, False
    for batch in batches:
        out: list[tuple] = []
        names = ("conv_id", "role", "digest", "kind", "lead", "text")
        for c, role, digest, kind, lead, text in zip(*(batch.column(x).to_pylist() for x in names), strict=True):
            if not began or c != conv:
                if began:
                    out.append((conv, hasher.hexdigest()))
                conv, hasher, began, wanted, written = c, hashlib.sha256(), True, None, False
            if kind == 1:  # a text: written if its edit came just before it
                if wanted is None or wanted[0] != digest:
                    continue
                line, wanted = f"{wanted[1]}{wanted[2] or role}:{text}", None
            elif kind == 0:
                wanted = (digest, lead, text)  # an edit carries the new role as its text
                continue
            else:
                line = lead[:-1]
                if not line:
                    continue
            hasher.update((("\n" if written else "") + line).encode())
            written = True
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], batch.schema.field("conv_id").type), pa.array([x[1] for x in out])], names=["conv_id", "repaired_sha256"])
    if began:
        yield pa.RecordBatch.from_arrays([pa.array([conv], batch.schema.field("conv_id").type), pa.array([hasher.hexdigest()])], names=["conv_id", "repaired_sha256"])


def repair(rows: DataFrame, every: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation of every.

    rows: conv_id, turn, role, text, copies, taken by turn (nulls first), then role, then the MD5 of the text with its
    conversation and role; equal rows follow each other. every: conv_id. A null conv_id is a conversation of its own.
    Roles count by their first sign; those of other signs, or none, are illegal and have to be turned or deleted.
    A conversation without rows has zeros, an empty audit and the hash of the empty string.
    """
    kind = dict(rows.dtypes)["conv_id"]
    marked = _marked(rows)
    dealt = marked.repartition(F.shiftright("pos", 33)).sortWithinPartitions("pos")
    segs = settle(arrow_map(dealt.select("conv_id", "turn", "role", "digest", "code", "pos"), _pieces, f"conv_id {kind}, {_PIECE_SQL}"), "segments")
    of = segs.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seg", "relation"))).alias("segs"))
    remain = arrow_map(of.select("segs"), _costs_after, "seg long, remain array<long>, first boolean")
    way = "array<struct<audit:string,state:long,cost:long>>"
    with_costs = segs.drop("relation").join(remain, "seg")
    ways = settle(arrow_map(with_costs, _traced, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in with_costs.schema) + f", ways {way}"), "ways")
    ends = F.transform("ways", lambda w: F.struct(w["state"].alias("state"), w["cost"].alias("cost")))
    short = ways.select("conv_id", F.struct("seg", ends.alias("ends"), "first_turn", "last_turn", *_COUNTS).alias("s"))
    chains = settle(
        arrow_map(
            short.groupBy("conv_id").agg(F.array_sort(F.collect_list("s"), lambda a, b: F.when(a["seg"] < b["seg"], -1).when(a["seg"] > b["seg"], 1).otherwise(0)).alias("segs")),
            _chained,
            f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, closing string, close_state long, entries array<struct<seg:long,state:long>>",
        ),
        "chains",
    )
    entry = chains.select(F.explode("entries").alias("e")).select("e.seg", "e.state")
    taken = ways.join(entry, "seg").withColumn("audit", F.get("ways", F.col("state").cast("int"))["audit"]).drop("ways")
    edits = arrow_map(taken.select("conv_id", "codes", "turns", "roles", "digests", "audit", "state"), _edits, f"conv_id {kind}, turn long, role string, digest binary, lead string, as_role string")
    close = F.element_at(F.array(*[F.lit("".join(x + "\n" for x in _inserted(q, len(CLOSING[q]))[0])) for q in range(4)]), F.col("close_state").cast("int") + 1)
    none = lambda t: F.lit(None).cast(t)
    lines = (
        edits.select("conv_id", F.lit(0).alias("last"), "turn", "role", "digest", F.lit(0).alias("kind"), "lead", F.col("as_role").alias("text"))
        .unionByName(rows.select("conv_id", F.lit(0).alias("last"), "turn", "role", _digest().alias("digest"), F.lit(1).alias("kind"), none("string").alias("lead"), "text"))
        .unionByName(chains.select("conv_id", F.lit(1).alias("last"), none("long").alias("turn"), F.lit("").alias("role"), F.lit(b"").alias("digest"), F.lit(2).alias("kind"), close.alias("lead"), none("string").alias("text")))
    )
    in_order = lines.repartition("conv_id").sortWithinPartitions("conv_id", "last", F.col("turn").asc_nulls_first(), "role", "digest", "kind")
    hashes = arrow_map(in_order.select("conv_id", "role", "digest", "kind", "lead", "text"), _hashed, f"conv_id {kind}, repaired_sha256 string")
    audit = taken.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seg", "audit"))).alias("all"))
    audit = audit.select(F.col("conv_id").alias("a"), F.array_join(F.transform("all", lambda x: x["audit"]), "").alias("audit"))
    found = chains.join(audit, F.col("conv_id").eqNullSafe(F.col("a"))).join(hashes.withColumnRenamed("conv_id", "h"), F.col("conv_id").eqNullSafe(F.col("h")))
    found = found.select(F.col("conv_id").alias("c"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", F.concat("audit", "closing").alias("audit"), "repaired_sha256")
    zero = {x: F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    out = every.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    return out.select("conv_id", *zero.values(), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def structure_report(conversations: DataFrame) -> DataFrame:
    """repair() of the damaged rows of all conversations. A null role or text, and a null in the hashed place, is one
    space: such a text is blank. Empty and very long texts are taken as they are; a table without rows gives none.
    Rows that repeat one of their conversation are duplicates. Columns of other names are ignored."""
    return repair(damaged(conversations), only(conversations, "conv_id"))
