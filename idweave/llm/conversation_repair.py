"""Conversation structure repair: cheapest edits that make roles alternate, by Four-Russians block tables.

Rows of a conversation, in order of their turns, are edited so that the initials of their roles
read ``(s?(ua)+)?``.  Keep costs 0, a new role 3, deletion 4 (blank and repeated rows must go),
an inserted empty turn 3; a truncated row that stays adds 3.  Of the cheapest edits the ASCII-least
string of initials (D, I, K, R) is taken.

A row is one of nine symbols.  The cost of finishing from each of the pattern's four states is a
vector; less its least entry it is one of few normalised vectors, whatever follows.  Tables give
the vector before every block of ``BLOCK`` symbols from the vector behind it.  A conversation is
read from its end block by block; then the blocks are expanded from the first on, each backward
from its own stored vector, and in each state the least initial that keeps the cost is taken, so
ties are decided on exact costs.

Two passes: rows without their texts (initial, state, two 64-bit hashes) are sorted by
conversation and yield the edits; then the texts, sorted likewise behind their conversation's
edits, stream through and come out repaired.  A task holds 40 bytes for each row of the
conversation at hand in the first pass and one byte, the audit's, in the second; texts are never
held.  (The audit of a conversation is one string and its digest one running hash: both need
its rows in one order in one task.)

Defined results: a null role or text reads as one space, a null turn comes first, rows with a null
conversation id form one conversation.  Rows of the same turn go by role, then by hash of the
text; repeated rows repeat and the later ones are duplicates.  Other columns are left out.  A
conversation without rows costs 0.  Texts of any length stream; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from .common import table

#: Costs of a new role, a deletion, an insertion, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Symbols in a block.
BLOCK = 4

#: states of the pattern: nothing yet, after s, after u, after a; the state that each initial leads to
_STEP = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
#: the only state that a user or assistant turn leads to, and that turn's role
_NEXT, _ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
#: symbols: initial s, u, a, other; the same truncated; a row that must go; nothing (fills a block up)
_INITIALS, _MUST_GO, _NOTHING, _SYMBOLS = "sua", 8, 9, 10
_WHITE = "\x20\t\n\x0b\x0c\r"


def _before(symbol, behind):
    """The costs before a row from those behind it, insertions in front of the row included."""
    if symbol == _NOTHING:
        return behind
    out = [DELETE + c for c in behind]
    if symbol != _MUST_GO:
        extra, initial = TRUNCATED if symbol >= 4 else 0, symbol % 4
        for q in range(4):
            kept = _STEP[_INITIALS[initial]][q] if initial < 3 else None
            if kept is not None:
                out[q] = min(out[q], extra + behind[kept])
            out[q] = min(out[q], extra + REROLE + behind[_NEXT[q]])
    for _ in range(2):
        out = [min(c, INSERT + out[_NEXT[q]]) for q, c in enumerate(out)]
    return tuple(out)


@lru_cache(maxsize=1)
def tables():
    """(one, one_cost, block, block_cost, letters, vectors): tables of normalised vectors by number.

    ``one[v, x]`` is the vector before symbol x, ``one_cost`` what normalising took off; ``block``
    has the same for a block's code, its first symbol weighing most.  ``letters[v][x][q]`` are the
    initials of the edits up to and with symbol x in state q, where v stands behind x, and the next state.
    """
    end = (0, 2 * INSERT, INSERT, 0)
    vectors, number, one, one_cost = [end], {end: 0}, [], []
    for v in vectors:  # grows until no symbol gives a new one
        row, cost = [], []
        for x in range(_SYMBOLS):
            before = _before(x, v)
            least = min(before)
            before = tuple(c - least for c in before)
            if before not in number:
                number[before] = len(vectors)
                vectors.append(before)
            row.append(number[before]), cost.append(least)
        one.append(row), one_cost.append(cost)
    one, one_cost = np.array(one, np.int32), np.array(one_cost, np.int32)
    block, block_cost = np.arange(len(vectors), dtype=np.int32)[:, None], np.zeros((len(vectors), 1), np.int32)
    for _ in range(BLOCK):  # one more symbol in front of the block
        block_cost = (block_cost[:, None, :] + one_cost[block].transpose(0, 2, 1)).reshape(len(vectors), -1)
        block = one[block].transpose(0, 2, 1).reshape(len(vectors), -1)
    letters = [[[_expanded(x, v, q) for q in range(4)] for x in range(_SYMBOLS)] for v in vectors]
    return one, one_cost, block, block_cost, letters, vectors


def _expanded(symbol, behind, q):
    """(initials, next state) of the least edits from state q up to and with a symbol."""
    if symbol == _NOTHING:
        return "", q
    out, before = "", _before(symbol, behind)
    while True:
        extra = TRUNCATED if 4 <= symbol < 8 else 0
        kept = _STEP[_INITIALS[symbol % 4]][q] if symbol < 8 and symbol % 4 < 3 else None
        if DELETE + behind[q] == before[q]:
            return out + "D", q
        if INSERT + before[_NEXT[q]] == before[q]:
            out, q = out + "I", _NEXT[q]
        elif kept is not None and extra + behind[kept] == before[q]:
            return out + "K", kept
        else:
            return out + "R", _NEXT[q]


def edits(symbols):
    """(cost, audit) of a conversation's symbols."""
    one, _, block, block_cost, letters, vectors = tables()
    symbols = [*symbols, *[_NOTHING] * (-len(symbols) % BLOCK)]
    v, cost, stored = 0, 0, []
    for a in range(len(symbols) - BLOCK, -1, -BLOCK):
        code = 0
        for x in symbols[a : a + BLOCK]:
            code = code * _SYMBOLS + x
        stored.append(v)
        v, cost = int(block[v, code]), cost + int(block_cost[v, code])
    cost += vectors[v][0]
    audit, q = [], 0
    for a, v in zip(range(0, len(symbols), BLOCK), reversed(stored)):
        own, behind = symbols[a : a + BLOCK], [v]
        for x in own[:0:-1]:
            behind.append(int(one[behind[-1], x]))
        for x, w in zip(own, reversed(behind)):
            found, q = letters[w][x][q]
            audit.append(found)
    return cost, "".join(audit) + "I" * (0, 2, 1, 0)[q]


# ---------------------------------------------------------------- first pass: the edits

_PLAN = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_PLAN_NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _conversations(batches):
    """Tables of whole conversations from sorted batches whose first column is the id."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        own = pa.Table.from_batches([batch])
        ids = own.column(0).combine_chunks()
        if held:
            ids = pa.concat_arrays([held[-1].column(0).combine_chunks().slice(held[-1].num_rows - 1, 1), ids])
        ends = _changes(ids)
        if not held:
            ends = ends + 1
        if len(ends):
            yield pa.concat_tables([*held, own.slice(0, int(ends[-1]))])
            held = [own.slice(int(ends[-1]))]
        else:
            held.append(own)
    if held:
        yield pa.concat_tables(held)


def _changes(ids):
    """Places k where ids[k + 1] is another one than ids[k]; nulls are equal."""
    a, b = ids.slice(0, len(ids) - 1), ids.slice(1)
    other = pc.fill_null(pc.not_equal(a, b), True)
    both = pc.and_(pc.is_null(a), pc.is_null(b))
    return np.flatnonzero(np.asarray(pc.and_not(other, both)))


def _planned(batches):
    """A row of _PLAN for each conversation of sorted rows (id, turn, initial, state, h1, h2, present)."""
    for rows in _conversations(batches):
        ids = rows.column(0).combine_chunks()
        begin = np.concatenate([[0], _changes(ids) + 1])
        owner = np.repeat(np.arange(len(begin)), np.diff([*begin, len(ids)]))
        present = np.asarray(rows.column("present"))
        first = ids.take(pa.array(begin))
        # from here on only rows that are there
        rows, owner = rows.filter(pa.array(present)), owner[present]
        n = len(begin)
        initial, state = rows.column("initial").to_numpy(), rows.column("state").to_numpy()
        order = np.lexsort((np.arange(len(owner)), rows.column("h2").to_numpy(), rows.column("h1").to_numpy(), owner))
        h1, h2, o = rows.column("h1").to_numpy()[order], rows.column("h2").to_numpy()[order], owner[order]
        again = np.zeros(len(owner), bool)
        again[order[1:]] = (o[1:] == o[:-1]) & (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
        blank = state == 2
        duplicate = again & ~blank
        truncated = (state == 1) & ~again
        pair = initial[:-1] * 4 + initial[1:]
        wrong = (owner[1:] == owner[:-1]) & ~np.isin(pair, (0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1))
        symbols = np.where(blank | duplicate, _MUST_GO, initial + 4 * truncated)
        count = lambda mask, at=owner: np.bincount(at[mask], minlength=n)
        places = np.searchsorted(owner, np.arange(n + 1))
        found = [edits(symbols[a:b].tolist()) for a, b in zip(places, places[1:])]
        columns = [_gaps(rows.column("turn").combine_chunks(), owner, n), count(blank), count(duplicate), count(truncated), count(wrong, owner[1:]), [c for c, _ in found]]
        arrays = [first, *(pa.array(c, pa.int64()) for c in columns), pa.array([a for _, a in found], pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, names=["conv", *_PLAN_NAMES])


def _gaps(turn, owner, n):
    """maxTurn - minTurn + 1 - distinctTurns of each conversation's known turns, which ascend."""
    known = np.asarray(pc.is_valid(turn), bool)
    turn, owner = np.asarray(pc.fill_null(turn, 0), np.int64)[known], owner[known]
    begin = np.searchsorted(owner, np.arange(n + 1))
    any_ = begin[1:] > begin[:-1]
    out = np.zeros(n, np.int64)
    new = np.ones(len(turn), np.int64)
    new[1:] = (turn[1:] != turn[:-1]) | (owner[1:] != owner[:-1])
    distinct = np.bincount(owner, weights=new, minlength=n).astype(np.int64)
    out[any_] = turn[begin[1:][any_] - 1] - turn[begin[:-1][any_]] + 1 - distinct[any_]
    return out


def _rows(rows, conv_col, turn_col, role_col, text_col, present):
    """conv, turn, role, text, h1, h2, present: nulls as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    out = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"), (F.lit(True) if present is None else F.coalesce(F.col(present), F.lit(False))).alias("present"))
    return out.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit(7), "text", "role")})


def plan_repairs(rows, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text", present=None):
    """conv and _PLAN of each conversation; where the column ``present`` is false a row only names its conversation."""
    return _plan(_rows(rows, conv_col, turn_col, role_col, text_col, present))


def _plan(src):
    end = F.right(F.rtrim(F.col("text"), F.lit(_WHITE)), F.lit(1))
    state = F.when(end == "", 2).when(end.isin(".", "!", "?"), 0).otherwise(1)
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    small = src.select("conv", "turn", initial.alias("initial"), state.alias("state"), "h1", "h2", "present", "role")
    small = small.repartition("conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "h1", "h2").drop("role")
    return small.mapInArrow(_planned, f"conv {src.schema['conv'].dataType.simpleString()}, {_PLAN}")


# ---------------------------------------------------------------- second pass: the texts


def _behind_plans(src):
    """Each conversation's plan and behind it its rows in order, sorted in partitions by conversation."""
    plan = _plan(src).select("conv", F.lit(True).alias("plan"), *_PLAN_NAMES, *[F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("h1", "long"), ("h2", "long"))])
    rows = src.filter("present").select("conv", F.lit(False).alias("plan"), *[F.lit(None).cast("string" if c == "audit" else "long").alias(c) for c in _PLAN_NAMES], "turn", "role", "text", "h1", "h2")
    both = plan.unionByName(rows).repartition("conv")
    both = both.sortWithinPartitions("conv", F.col("plan").desc(), F.col("turn").asc_nulls_first(), "role", "h1", "h2")
    return both.drop("turn", "h1", "h2")


def _repairs(batches):
    """(conv, plan, None) of each conversation, then ("I" or its letter, role, text) of each turn that it has after repair."""
    audit, at, q, conv, first = "", 0, 0, None, True

    def inserted():
        nonlocal at, q
        while at < len(audit) and audit[at] == "I":
            at += 1
            role, q = _ROLE[q], _NEXT[q]
            yield conv, None, ("I", role, "")

    for batch in batches:
        columns = {c: batch.column(c).to_pylist() for c in ("conv", "plan", *_PLAN_NAMES, "role")}
        texts = batch.column("text")
        for k, is_plan in enumerate(columns["plan"]):
            if is_plan:
                yield from inserted()
                conv, audit, at, q, first = columns["conv"][k], columns["audit"][k], 0, 0, False
                yield conv, tuple(columns[c][k] for c in _PLAN_NAMES), None
                continue
            yield from inserted()
            letter, at = audit[at], at + 1
            if letter == "D":
                continue
            role = columns["role"][k] if letter == "K" else _ROLE[q]
            q = _STEP[role[0]][q] if letter == "K" else _NEXT[q]
            yield conv, None, (letter, role, texts[k].as_py())
    if not first:
        yield from inserted()


def _repaired_rows(kind):
    def run(batches):
        rows, place, size = [], 0, 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (kind, pa.int64(), pa.string(), pa.string(), pa.string()))], names=["conv", "place", "edit", "role", "text"])
        for conv, plan, turn in _repairs(batches):
            if plan:
                place = 0
                continue
            rows.append((conv, place, *turn))
            place, size = place + 1, size + len(turn[2]) + 64
            if size > 4 << 20:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()

    return run


def _digests(kind):
    def run(batches):
        rows, digest, some = [], None, False
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (kind, *[pa.int64()] * 6, pa.string(), pa.string()))], names=["conv", *_PLAN_NAMES, "repaired_sha256"])
        for conv, plan, turn in _repairs(batches):
            if plan:
                if rows:
                    rows[-1] += (digest.hexdigest(),)
                if len(rows) >= 4096:
                    yield batch()
                    rows = []
                rows.append((conv, *plan))
                digest, some = hashlib.sha256(), False
            else:
                digest.update(f"\n{turn[1]}:{turn[2]}".encode() if some else f"{turn[1]}:{turn[2]}".encode())
                some = True
        if rows:
            rows[-1] += (digest.hexdigest(),)
            yield batch()

    return run


def _kind(src):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(src.schema["conv"].dataType), src.schema["conv"].dataType.simpleString()


def repair(rows, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text", present=None):
    """The repaired conversations: conv, place, edit (K, R or I), role and text of each turn."""
    src = _rows(rows, conv_col, turn_col, role_col, text_col, present)
    kind, name = _kind(src)
    return _behind_plans(src).mapInArrow(_repaired_rows(kind), f"conv {name}, place long, edit string, role string, text string")


def repair_report(rows, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text", present=None):
    """conv, _PLAN and repaired_sha256 of each conversation, the digest of its repaired turns' ``role:text`` lines."""
    src = _rows(rows, conv_col, turn_col, role_col, text_col, present)
    kind, name = _kind(src)
    return _behind_plans(src).mapInArrow(_digests(kind), f"conv {name}, {_PLAN}, repaired_sha256 string")


# ---------------------------------------------------------------- the query


def damaged(rows):
    """conv_id, turn, role, text, present of conversations with faults by crc32 of ``conv_id:turn`` mod 20."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20).cast("int")
    out = rows.select("conv_id", "turn", fault.alias("fault"), space("role").alias("role"), space("text").alias("text"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return out.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fault") != 0).alias("present"), copies.alias("copy"))


def query(spark, sf_dir):
    return repair_report(damaged(table(spark, sf_dir, "conversations")), present="present").withColumnRenamed("conv", "conv_id")
