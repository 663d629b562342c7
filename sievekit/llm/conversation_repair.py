"""Conversation structure repair: cheapest edits by survivor-coalescence Viterbi.

A conversation is repaired to the roles ``(s?(ua)+)?`` (initials of system,
user, assistant; or to nothing) by keeping, re-roling, deleting and inserting
turns. The states of the search are what the last role kept was: nothing, s, u
or a. Each state has one survivor, the cheapest edits that lead to it, of equal
costs the one whose string of edit initials is least. Survivors are leaves of a
tree of back pointers. A node counts what points to it and goes when nothing
does; as soon as all survivors descend from one node, the edits up to it are
final and leave the tree together with their rows. So memory holds what is
unresolved only, and tied survivors are compared over all of that: no tied
string is a prefix of the other, since each string fixes states and cost.

Rows are grouped by all their columns first (repeats become a count), the
earliest turn of each (conversation, role, text) marks later ones as
duplicates, and a range sort deals rows to tasks by (conversation, turn). A
task packs them into blocks of bounded size. A conversation that lies within
one block is repaired at once. One that spans blocks or tasks, however long, is
not gathered: each block gives, for each state before it, costs and order of
the ways to each state after it; a pass over these few numbers, last block
first, finds what remains to be paid, a second one the states between the
blocks, and then every block is repaired by itself.

Only the digest of a report reads a long conversation in one go, since SHA-256
has no other way; it streams block by block.

Defined results: a NULL role or text counts as one space, so such a text is
blank; a NULL turn comes first; rows of equal turn go by role, then text; rows
equal in all are neighbours, the first of them may stay; ``copies`` 0 keeps a
conversation in the result without a row; NULL is a conversation like any
other; texts of any length are compared and copied whole; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from functools import cmp_to_key

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices

START, AFTER_S, AFTER_U, AFTER_A = range(4)
STEP = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A,
        (AFTER_A, "u"): AFTER_U}
TURN = {START: AFTER_U, AFTER_S: AFTER_U, AFTER_U: AFTER_A, AFTER_A: AFTER_U}  # by a user's or assistant's turn
ROLE = {AFTER_U: "user", AFTER_A: "assistant"}
ENDS = (START, AFTER_A)
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

BLOCK_ROWS = 1024        # distinct rows of a block
BLOCK_CHARS = 1 << 20    # characters of its texts, but for the last row

NOT_BLANK = re.compile(r"[^\x20\x09-\x0D]")
SENTENCE_END = re.compile(r"[.!?][\x20\x09-\x0D]*\Z")


class Node:
    """An edit, behind those of its parent. ``times`` > 1 for a run of deletions."""

    __slots__ = ("parent", "edit", "times", "state", "row", "depth", "refs")

    def __init__(self, parent, edit, times, state, row):
        self.parent, self.edit, self.times, self.state, self.row = parent, edit, times, state, row
        self.depth = parent.depth + 1 if parent else 0
        self.refs = 0
        if parent:
            parent.refs += 1


def release(node: Node) -> None:
    """One pointer to the node less; drops it and what only it held."""
    node.refs -= 1
    while node.refs == 0 and node.parent:
        node.parent.refs -= 1
        node = node.parent


def branches(a: Node, b: Node) -> tuple[str, str]:
    """The edits of both from where their paths part."""
    left, right = [], []
    while a is not b:
        if a.depth >= b.depth:
            left.append(a.edit * a.times)
            a = a.parent
        else:
            right.append(b.edit * b.times)
            b = b.parent
    return "".join(reversed(left)), "".join(reversed(right))


class Repairer:
    """Streaming search from one state. ``push`` and ``finish`` return the edits
    that have become final, as (edit, times, state after it, row)."""

    def __init__(self, entry: int = START, opening: bool = True):
        """``opening``: turns may be inserted before the first row."""
        self.root = Node(None, "", 0, entry, None)
        self.cost: list[int | None] = [None] * 4
        self.tip: list[Node | None] = [None] * 4
        self.cost[entry], self.tip[entry] = 0, self.root
        self.root.refs = 1
        if opening:
            self._insert()

    def _better(self, state: int, cost: int, parent: Node, edit: str) -> bool:
        """Whether the parent's path and the edit beat the state's survivor."""
        held = self.cost[state]
        if held is None or cost != held:
            return held is None or cost < held
        own, other = branches(parent, self.tip[state])
        return own + edit < other

    def _take(self, state: int, cost: int, node: Node) -> None:
        node.refs += 1
        if self.tip[state] is not None:
            release(self.tip[state])
        self.cost[state], self.tip[state] = cost, node

    def _insert(self) -> None:
        changed = True
        while changed:
            changed = False
            for state, to in TURN.items():
                if self.cost[state] is not None and self._better(to, self.cost[state] + INSERT, self.tip[state], "I"):
                    self._take(to, self.cost[state] + INSERT, Node(self.tip[state], "I", 1, to, None))
                    changed = True

    def _advance(self, ways) -> list:
        """``ways(state)``: (edit, times, state after, cost) of each edit of one row."""
        before = [(s, self.cost[s], self.tip[s]) for s in range(4) if self.tip[s] is not None]
        row, self.cost, self.tip = self.row, [None] * 4, [None] * 4
        for state, cost, tip in before:
            for edit, times, to, more in ways(state):
                if self._better(to, cost + more, tip, edit):
                    self._take(to, cost + more, Node(tip, edit, times, to, row))
        for _, _, tip in before:
            release(tip)
        self._insert()
        self._drop_hopeless()
        return self._settled()

    def _drop_hopeless(self) -> None:
        """Drop survivors that no rows to come can make part of the cheapest edits.

        Whatever follows ``s`` also follows ``a``; what follows nothing does too,
        but for a system's turn, whose deletion instead costs DELETE at most;
        and from ``u`` an insertion leads to ``a``. Without this, the edits that
        delete every turn would hold the tree for ever.
        """
        through_a = [c + more for c, more in ((self.cost[AFTER_A], 0), (self.cost[AFTER_U], INSERT)) if c is not None]
        for state, more in ((START, DELETE), (AFTER_S, 0)):
            if through_a and self.tip[state] is not None and self.cost[state] > min(through_a) + more:
                release(self.tip[state])
                self.cost[state] = self.tip[state] = None

    def push(self, initial: str, truncated: bool, row) -> list:
        """A row that may stay."""
        more = TRUNCATED if truncated else 0

        def ways(state):
            yield "D", 1, state, DELETE
            if (to := STEP.get((state, initial))) is not None:
                yield "K", 1, to, more
            yield "R", 1, TURN[state], REROLE + more

        self.row = row
        return self._advance(ways)

    def push_deleted(self, times: int) -> list:
        """A run of rows that must go."""
        self.row = None
        return self._advance(lambda state: [("D", times, state, DELETE * times)])

    def _path(self, tip: Node) -> list[Node]:
        out = []
        while tip is not self.root:
            out.append(tip)
            tip = tip.parent
        return out[::-1]

    def _settled(self) -> list:
        """Edits up to the last node that all survivors share."""
        out = []
        if self.root.refs == 1 and self.root not in self.tip:
            for node in self._path(next(t for t in self.tip if t is not None)):
                if self.root.refs != 1 or self.root in self.tip:
                    break
                node.parent, self.root = None, node
                out.append((node.edit, node.times, node.state, node.row))
        return out

    def finish(self, end: int | None = None) -> tuple[int, list]:
        """Cost and the remaining edits; the cheapest end that is allowed, or ``end``."""
        if end is None:
            ends = [s for s in ENDS if self.tip[s] is not None]
            end = min(ends, key=cmp_to_key(lambda x, y: self.cost[x] - self.cost[y] or self.order(x, y)))
        return self.cost[end], [(n.edit, n.times, n.state, n.row) for n in self._path(self.tip[end])]

    def order(self, x: int, y: int) -> int:
        own, other = branches(self.tip[x], self.tip[y])
        return (own > other) - (own < other)


def initial(role: str) -> str:
    return role[:1]


def faults(text: str, duplicate: bool, copies: int) -> tuple[str, int]:
    """(fault of the first copy or '', number of copies that must go)."""
    if not NOT_BLANK.search(text):
        return "blank", copies
    if duplicate:
        return "duplicate", copies
    return ("" if SENTENCE_END.search(text) else "truncated"), copies - 1


def push_rows(repairer: Repairer, rows):
    """Push (role, text, copies, duplicate) rows; yield the lists of final edits."""
    for role, text, copies, duplicate in rows:
        fault, gone = faults(text, duplicate, copies)
        if gone < copies:
            yield repairer.push(initial(role), fault == "truncated", (role, text))
        if gone:
            yield repairer.push_deleted(gone)


def repair_rows(rows, entry: int = START, opening: bool = True, end: int | None = None):
    """(cost, audit, repaired (role, text) pairs) of the rows of a block."""
    repairer, audit, repaired = Repairer(entry, opening), [], []

    def emit(edits):
        for edit, times, state, row in edits:
            audit.append(edit * times)
            if edit == "K":
                repaired.append(row)
            elif edit != "D":
                repaired.append((ROLE[state], row[1] if row else ""))

    for edits in push_rows(repairer, rows):
        emit(edits)
    cost, edits = repairer.finish(end)
    emit(edits)
    return cost, "".join(audit), repaired


def ways_through(rows, opening: bool) -> tuple[list[int], str, str]:
    """What a block costs between any two states.

    Costs by state before and after (-1: no way), the first edit's initial of
    each (space: none), and how the edits to two states after compare: ``<``,
    ``>``, or ``p`` and ``q`` where the first or the second begins the other.
    """
    costs, firsts, orders = [], [], []
    for entry in range(4):
        r, head = Repairer(entry, opening and entry == START), ""
        for edits in push_rows(r, rows):
            head = head or "".join(e for e, *_ in edits[:1])
        for x in range(4):
            if r.tip[x] is None:
                costs.append(-1)
                firsts.append(" ")
            else:
                costs.append(r.cost[x])
                firsts.append(head or (r._path(r.tip[x])[0].edit if r.tip[x] is not r.root else " "))
            for y in range(4):
                if r.tip[x] is None or r.tip[y] is None or x == y:
                    orders.append(" ")
                    continue
                own, other = branches(r.tip[x], r.tip[y])
                orders.append("p" if not own else "q" if not other else "<" if own < other else ">")
    return costs, "".join(firsts), "".join(orders)


def rest_of(costs: list[int], firsts: str, orders: str, rest: list[int | None], ahead: list[str]):
    """Fold a block before what follows it.

    ``rest`` and ``ahead`` are, by state after the block, the cost of the best
    edits of all that follows and their first initial ('' if there are none).
    Returns both for the states before it, and the state after it that is best.
    """
    to, out, head = [], [], []
    for e in range(4):
        best = None
        for x in range(4):
            if costs[4 * e + x] < 0 or rest[x] is None:
                continue
            total = costs[4 * e + x] + rest[x]
            if best is None or total < best[0] or total == best[0] and _first(orders[16 * e + 4 * x + best[1]], x, best[1], ahead):
                best = (total, x)
        out.append(best and best[0])
        to.append(best[1] if best else -1)
        head.append("" if best is None else firsts[4 * e + best[1]].strip() or ahead[best[1]])
    return out, head, to


def _first(order: str, x: int, y: int, ahead: list[str]) -> bool:
    """Whether the edits through x come before those through y, of equal cost.
    Where one begins the other, the other goes on with an insertion."""
    if order == "p":
        return ahead[x] < "I"
    return order == "<" or order == "q" and ahead[y] > "I"


# --- Spark jobs -----------------------------------------------------------

_ROWS = ("conv_id {conv}, block long, alone boolean, turns array<long>, roles array<string>, texts array<string>, "
         "copies array<long>, duplicates array<boolean>")
_REPAIRED = ("conv_id {conv}, block long, alone boolean, cost long, audit string, blank long, duplicate long, "
             "truncated long, illegal long, n_rows long, first_initial string, last_initial string, first_turn long, "
             "last_turn long, n_turns long, repaired array<struct<role:string,text:string>>")


def _grouped(turns: DataFrame, copies: str | None) -> DataFrame:
    """Distinct rows in blocks: conversation, rows in order, whether the block
    is known to hold all of the conversation."""
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), *spaced,
                        (F.col(copies) if copies else F.lit(1)).cast("long").alias("copies"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    # lengths before the parts, so that different parts never join to the same string
    key = F.unhex(F.sha2(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("null ")),
                                     F.length("role").cast("string"), "role", "text"), 256))
    keyed = rows.withColumn("digest", key)
    again = (keyed.where("copies > 0").groupBy("digest")
             .agg(F.min(F.struct("turn")).alias("earliest"), F.count("*").alias("n")).where("n > 1").drop("n"))
    later = F.coalesce(~F.struct("turn").eqNullSafe(F.col("earliest")), F.lit(False))
    marked = (keyed.join(again, "digest", "left")
              .select("conv_id", "turn", "role", "text", "copies",
                      (F.col("earliest").isNotNull() & later).alias("duplicate")))
    order = ["conv_id", "turn", "role", "text"]
    conv = turns.schema["conv_id"].dataType
    return marked.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _pack, _ROWS.format(conv=conv.simpleString()))


def _pack(batches):
    """Consecutive rows of a conversation, up to a block's size."""
    names = ["turns", "roles", "texts", "copies", "duplicates"]
    number, n_convs, held, chars, conv, started = TaskContext.get().partitionId() << 32, 0, [], 0, None, False
    split = False  # whether the conversation has an earlier block here
    out, kind = [], None

    def block(alone):
        nonlocal number, held, chars
        out.append((conv, number, alone, held))
        number, held, chars = number + 1, [], 0

    def record():
        columns = [pa.array([b[0] for b in out], kind), pa.array([b[1] for b in out], pa.int64()),
                   pa.array([b[2] for b in out], pa.bool_())]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
        columns += [pa.array([[r[i] for r in b[3]] for b in out], pa.list_(t)) for i, t in enumerate(types)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, names=["conv_id", "block", "alone", *names])

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for columns in slices(batch, ["conv_id", "turn", "role", "text", "copies", "duplicate"]):
            for conv_id, turn, role, text, copies, duplicate in zip(*columns):
                if not started or conv_id != conv:
                    if started:
                        block(n_convs > 1 and not split)  # the task's first one may have begun in another task
                    conv, started, split, n_convs = conv_id, True, False, n_convs + 1
                elif len(held) >= BLOCK_ROWS or chars >= BLOCK_CHARS:
                    block(False)
                    split = True
                if copies:
                    held.append((turn, role, text, copies, duplicate))
                    chars += len(text)
            if out:
                yield record()
    if started:
        block(False)  # may go on in the next task
        yield record()


def _blocks_of(batch):
    """(conv_id, block, rows) with rows as the search takes them."""
    for columns in slices(batch, ["conv_id", "block", "turns", "roles", "texts", "copies", "duplicates"], 64):
        for conv_id, block, turns, roles, texts, copies, duplicates in zip(*columns):
            yield conv_id, block, turns, list(zip(roles, texts, copies, duplicates))


def _states_between(open_blocks: DataFrame) -> DataFrame:
    """(block, entry, opening, end) of blocks of conversations that may span several."""
    conv = open_blocks.schema["conv_id"].dataType.simpleString()

    def through(batches):
        for batch in batches:
            found = [(c, b, *ways_through(rows, True), ways_through(rows, False)) for c, b, _, rows in _blocks_of(batch)]
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[0] for f in found], batch.schema.field("conv_id").type),
                     pa.array([f[1] for f in found], pa.int64())]
                    + [pa.array([f[5][i] for f in found], t) for i, t in
                       enumerate([pa.list_(pa.int64()), pa.string(), pa.string()])]
                    + [pa.array([f[2 + i][:n] for f in found], t) for i, (n, t) in
                       enumerate([(4, pa.list_(pa.int64())), (4, pa.string()), (16, pa.string())])],
                    names=["conv_id", "block", "costs", "firsts", "orders", "costs0", "firsts0", "orders0"])

    def backward(batches):
        """Last block first: the best state after each block, by the state before it."""
        conv, seen, rest, ahead = None, False, None, None
        for batch in batches:
            out = []
            for c, b, costs, firsts, orders, costs0, firsts0, orders0 in zip(*[x.to_pylist() for x in batch.columns]):
                if not seen or c != conv:
                    conv, seen = c, True
                    rest, ahead = [0 if s in ENDS else None for s in range(4)], [""] * 4
                # as the first block, it starts from nothing and may open with an insertion
                to0 = rest_of([*costs0, *[-1] * 12], firsts0.ljust(16), orders0.ljust(64), rest, ahead)[2][START]
                rest, ahead, to = rest_of(costs, firsts, orders, rest, ahead)
                out.append((c, b, [to0, *to]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], batch.schema.field("conv_id").type),
                 pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.list_(pa.int32()))],
                names=["conv_id", "block", "to"])

    def forward(batches):
        conv, seen, state = None, False, START
        for batch in batches:
            out = []
            for c, b, to in zip(*[x.to_pylist() for x in batch.columns]):
                opening = not seen or c != conv
                if opening:
                    conv, seen, state = c, True, START
                after = to[0] if opening else to[1 + state]
                out.append((b, state, opening, after))
                state = after
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], t) for i, t in
                 enumerate([pa.int64(), pa.int32(), pa.bool_(), pa.int32()])], names=["block", "entry", "opening", "end"])

    ways = open_blocks.select("conv_id", "block", "turns", "roles", "texts", "copies", "duplicates").mapInArrow(
        through, f"conv_id {conv}, block long, costs array<long>, firsts string, orders string, "
                 "costs0 array<long>, firsts0 string, orders0 string")
    last_first = ways.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("block"))
    best = last_first.mapInArrow(backward, f"conv_id {conv}, block long, to array<int>")
    return best.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(
        forward, "block long, entry int, opening boolean, end int")


def _repair_blocks(blocks: DataFrame) -> DataFrame:
    """The repaired form of each block, given the states around it (end NULL: the best one)."""

    def one(conv_id, block, turns, rows, alone, entry, opening, end):
        cost, audit, repaired = repair_rows(rows, entry, opening, end)
        counts = {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
        illegal = 0
        for at, (role, text, copies, duplicate) in enumerate(rows):
            fault, gone = faults(text, duplicate, copies)
            counts[fault] += copies if gone == copies else 1
            counts["duplicate"] += gone if gone < copies else 0
            illegal += copies - 1 + (at > 0 and initial(rows[at - 1][0]) + initial(role) not in ("su", "ua", "au"))
        known = [t for t in turns if t is not None]
        n_turns = sum(1 for at, t in enumerate(known) if not at or t != known[at - 1])
        return (conv_id, block, alone, cost, audit, counts["blank"], counts["duplicate"], counts["truncated"], illegal,
                sum(r[2] for r in rows), initial(rows[0][0]) if rows else None, initial(rows[-1][0]) if rows else None,
                known[0] if known else None, known[-1] if known else None, n_turns,
                [{"role": r, "text": t} for r, t in repaired])

    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.string(), *[pa.int64()] * 5, pa.string(), pa.string(),
             *[pa.int64()] * 3, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))]
    schema = _REPAIRED.format(conv=blocks.schema["conv_id"].dataType.simpleString())
    names = [part.split()[0] for part in re.sub(r"<.*>", "", schema).split(", ")]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                given = zip(*[part.column(part.schema.get_field_index(c)).to_pylist()
                              for c in ("alone", "entry", "opening", "end")])
                done = [one(*b, *g) for b, g in zip(_blocks_of(part), given)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*done), [part.schema.field("conv_id").type, *kinds])], names=names)

    return blocks.mapInArrow(run, schema)


def repair(turns: DataFrame, copies: str | None = None) -> DataFrame:
    """Repaired conversations in blocks, ordered by (conv_id, block).

    ``turns``: conv_id, turn, role, text, and optionally a column with how
    often the row occurs. A block has its edits' initials (``audit``) and
    ``cost``, the repaired turns, the number of rows by fault, and what is
    needed to add up neighbouring blocks. ``alone``: it is the whole conversation.
    """
    blocks = cut(_grouped(turns, copies), "blocks")
    alone = blocks.where("alone").select(
        "*", F.lit(START).alias("entry"), F.lit(True).alias("opening"), F.lit(None).cast("int").alias("end"))
    spanning = blocks.where("not alone")
    return _repair_blocks(alone.unionByName(spanning.join(_states_between(spanning), "block").select(alone.columns)))


def repaired_turns(turns: DataFrame, copies: str | None = None) -> DataFrame:
    """One row per turn of the repaired conversations: conv_id, block, at, role, text."""
    return repair(turns, copies).select("conv_id", "block", F.posexplode("repaired").alias("at", "turn")).select(
        "conv_id", "block", "at", "turn.role", "turn.text")


REPORT = ("conv_id {conv}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string")


def _reports(batches):
    """Add up the blocks of each conversation, which come in order."""
    kind, out, total, conv, seen = None, [], None, None, False

    def close():
        low, high, n_turns = total["first_turn"], total["last_turn"], total["n_turns"]
        out.append((conv, 0 if low is None else high - low + 1 - n_turns, total["blank"], total["duplicate"],
                    total["truncated"], total["illegal"], total["cost"], "".join(total["audit"]), total["sha"].hexdigest()))

    def record():
        columns = [pa.array(x, t) for x, t in zip(zip(*out), [kind, *[pa.int64()] * 6, pa.string(), pa.string()])]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, names=[p.split()[0] for p in REPORT.split(", ")])

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        names = batch.schema.names
        for columns in slices(batch, names, 64):
            for values in zip(*columns):
                b = dict(zip(names, values))
                if not seen or b["conv_id"] != conv:
                    if seen:
                        close()
                    conv, seen = b["conv_id"], True
                    total = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": [],
                             "n_turns": 0, "first_turn": None, "last_turn": None, "initial": None, "any": False,
                             "sha": hashlib.sha256()}
                for c in ("blank", "duplicate", "truncated", "illegal", "cost", "n_turns"):
                    total[c] += b[c]
                if b["n_rows"]:
                    total["illegal"] += total["initial"] is not None and (
                        total["initial"] + b["first_initial"] not in ("su", "ua", "au"))
                    total["initial"] = b["last_initial"]
                if b["n_turns"]:
                    total["n_turns"] -= total["last_turn"] == b["first_turn"]
                    if total["first_turn"] is None:
                        total["first_turn"] = b["first_turn"]
                    total["last_turn"] = b["last_turn"]
                total["audit"].append(b["audit"])
                if b["repaired"]:
                    text = "\n".join(f"{r['role']}:{r['text']}" for r in b["repaired"])
                    total["sha"].update((("\n" if total["any"] else "") + text).encode())
                    total["any"] = True
            if out:
                yield record()
    if seen:
        close()
        yield record()


def report(turns: DataFrame, copies: str | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256: one row per conversation."""
    blocks = cut(repair(turns, copies), "repaired")
    schema = REPORT.format(conv=blocks.schema["conv_id"].dataType.simpleString())
    spanning = blocks.where("not alone").repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return blocks.where("alone").mapInArrow(_reports, schema).unionByName(spanning.mapInArrow(_reports, schema))


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with drawn faults and ``copies``: by crc32 of ``conv_id:turn`` modulo
    20, 0 drops the row, 1 empties its text, 2 removes its sentence ends, 3
    repeats it, 4 makes it the user's. NULL counts as one space."""
    spaced = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    draw = F.crc32(F.concat_ws(":", spaced["conv_id"], spaced["turn"]).cast("binary")) % 20
    return conversations.select(
        "conv_id", "turn",
        F.when(draw == 4, "user").otherwise(spaced["role"]).alias("role"),
        F.when(draw == 1, "").when(draw == 2, F.regexp_replace(spaced["text"], "[.!?]", ""))
        .otherwise(spaced["text"]).alias("text"),
        F.when(draw == 0, 0).when(draw == 3, 2).otherwise(1).alias("copies"))


# --- DuckDB twin -----------------------------------------------------------

def _least(*ways):
    return f"list_min([{', '.join(ways)}])"


def _add(state, cost, edit, turn="''"):
    """The state's best edits with one more; NULL stays NULL."""
    return (f"CASE WHEN {state} IS NULL THEN NULL ELSE struct_pack("
            f"k := lpad((substr({state}.k, 1, 10)::BIGINT + {cost})::VARCHAR, 10, '0') || substr({state}.k, 11) || '{edit}', "
            f"r := {state}.r || {turn}) END")


def oracle_sql() -> str:
    """The report in DuckDB SQL: the best edits of each state, as cost and
    initials in one string (so that the least string is the cheapest, then the
    least in ASCII), row after row of a recursive query; crc32 by its table."""
    user, assistant = r"chr(10) || 'user:'", r"chr(10) || 'assistant:'"
    kept = "chr(10) || role || ':' || text"

    def keep(state, first):
        return f"CASE WHEN stays AND left(role, 1) = '{first}' THEN {_add(state, 'more', 'K', kept)} END"

    def rerole(state, turn):
        return f"CASE WHEN stays THEN {_add(state, 'more + 3', 'R', f'{turn} || text')} END"

    def insert(c0, c1, c2, c3):
        """Columns of the four states after insertions, as nested selects."""
        to_u = _least(c2, *[_add(c, 3, "I", user) for c in (c0, c1, c3)])
        return to_u, _least(c3, _add("s2", 3, "I", assistant))

    nothing = "struct_pack(k := '0000000000', r := '')"
    u0, a0 = insert("s0", "s1", "NULL", "NULL")
    u1, a1 = insert("s0", "s1", "c2", "c3")
    return rf"""
WITH RECURSIVE bits AS (
  SELECT range AS i, range AS v, 0 AS step FROM range(256)
  UNION ALL SELECT i, xor(v >> 1, 3988292384 * (v & 1)), step + 1 FROM bits WHERE step < 8),
keys AS (SELECT DISTINCT conv_id, turn, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s
         FROM conversations),
crc AS (
  SELECT conv_id, turn, s, 0 AS place, 4294967295::BIGINT AS c FROM keys
  UNION ALL SELECT conv_id, turn, s, place + 1, xor(c >> 8, v) FROM crc
            JOIN bits ON step = 8 AND i = xor(c, ascii(substr(s, place + 1, 1))::BIGINT) & 255 WHERE place < length(s)),
drawn AS (SELECT conv_id, turn, xor(c, 4294967295) % 20 AS d FROM crc WHERE place = length(s)),
spaced AS (SELECT c.conv_id, c.turn, d, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text
           FROM conversations c JOIN drawn x ON c.conv_id IS NOT DISTINCT FROM x.conv_id
                                             AND c.turn IS NOT DISTINCT FROM x.turn),
damaged AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
                   CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM spaced, range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM damaged),
faults AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                          WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
                          WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
                  left(lag(role) OVER w, 1) || left(role, 1) AS pair
           FROM ordered WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
marked AS (SELECT *, fault IN ('', 'truncated') AS stays, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS more FROM faults),
convs AS (SELECT DISTINCT conv_id FROM conversations),
best AS (
  SELECT conv_id, 0::BIGINT AS place, s0, s1, s2, {a0} AS s3
  FROM (SELECT conv_id, s0, s1, {u0} AS s2
        FROM (SELECT conv_id, {nothing} AS s0, CASE WHEN false THEN {nothing} END AS s1 FROM convs))
  UNION ALL
  SELECT conv_id, place, s0, s1, s2, {a1} AS s3
  FROM (SELECT conv_id, place, s0, s1, c3, {u1} AS s2
        FROM (SELECT b.conv_id, place + 1 AS place,
                     {_add('s0', 4, 'D')} AS s0,
                     {_least(_add('s1', 4, 'D'), keep('s0', 's'))} AS s1,
                     {_least(_add('s2', 4, 'D'), *[keep(s, 'u') for s in ('s0', 's1', 's3')],
                           *[rerole(s, user) for s in ('s0', 's1', 's3')])} AS c2,
                     {_least(_add('s3', 4, 'D'), keep('s2', 'a'), rerole('s2', assistant))} AS c3
              FROM best b JOIN marked m ON m.conv_id IS NOT DISTINCT FROM b.conv_id AND m.pos = place + 1))),
ends AS (SELECT conv_id, arg_max({_least('s0', 's3')}, place) AS e FROM best GROUP BY conv_id),
counts AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps,
                  count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                  count(*) FILTER (fault = 'truncated') AS truncated,
                  count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id)
SELECT ends.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, substr(e.k, 1, 10)::BIGINT AS cost,
       substr(e.k, 11) AS audit, sha256(substr(e.r, 2)) AS repaired_sha256
FROM ends LEFT JOIN counts ON ends.conv_id IS NOT DISTINCT FROM counts.conv_id
"""
