"""Conversation structure repair: the cheapest edits that give each conversation the roles (s?(ua)+)?, by a scan of min-plus
matrices.

The grammar has four states: 0 nothing yet, 1 after the system turn, 2 after a user turn, 3 after an assistant turn; 0 and 3
accept. Each turn is a 4x4 matrix over (cost, audit): from state i to state j at the least cost, of equal costs with the
ASCII-least audit. Sums take that minimum, products add costs and join audits. Two audits of one stretch of turns with equal
costs are never prefixes of each other (what a prefix lacks is insertions, which cost), so joining keeps their order, products
are associative, and matrices may be multiplied in any tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import FREQUENT, mapped, spread_join, stored

KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3  # costs; CUT is added for a truncated turn that stays
ROLES = {"u": "user", "a": "assistant"}
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
NEXT = "uuau"  # the role that an inserted or re-roled turn gets in each state
LEGAL = ("su", "ua", "au")

#: (cost, audit, lengths of the leaves' audits, states between leaves), or None where there is no way.
Element = tuple[int, str, tuple[int, ...], tuple[int, ...]] | None
Matrix = list[list[Element]]


def times(x: Matrix, y: Matrix, joint: bool = False) -> Matrix:
    """The product. joint: x and y end and start at leaves, whose borders are noted."""
    out: Matrix = []
    for row in x:
        line: list[Element] = []
        for j in range(4):
            best: Element = None
            for k in range(4):
                if (a := row[k]) is not None and (b := y[k][j]) is not None and (best is None or (a[0] + b[0], a[1] + b[1]) < best[:2]):
                    best = (a[0] + b[0], a[1] + b[1], a[2] + b[2], (*a[3], k, *b[3]) if joint else ())
            line.append(best)
        out.append(line)
    return out


def closure() -> Matrix:
    """Any number of insertions: more than two in a row never help."""
    out: Matrix = [[(0, "", (), ()) if i == j else None for j in range(4)] for i in range(4)]
    for i in range(4):
        state, audit = i, ""
        for _ in range(2):
            state, audit = STEPS[state, NEXT[state]], audit + "I"
            if out[i][state] is None:
                out[i][state] = (INSERT * len(audit), audit, (), ())
    return out


INSERTIONS = closure()


@cache
def turn(initial: str, fault: str) -> Matrix:
    """The matrix of a turn, insertions behind it included."""
    extra = CUT if fault == "truncated" else 0
    out: Matrix = [[None] * 4 for _ in range(4)]
    for i in range(4):
        ways = [(DELETE, "D", i)]
        if fault not in ("blank", "duplicate"):
            ways.append((REROLE + extra, "R", STEPS[i, NEXT[i]]))
            if (i, initial) in STEPS:
                ways.append((KEEP + extra, "K", STEPS[i, initial]))
        for cost, audit, j in ways:
            if out[i][j] is None or (cost, audit) < out[i][j][:2]:
                out[i][j] = (cost, audit, (), ())
    return times(out, INSERTIONS)


def product(matrices: list[Matrix], joint: bool = False) -> Matrix:
    """The product of matrices in order, as a balanced tree: each letter of an audit is copied once a level."""
    while len(matrices) > 1:
        matrices = [times(*matrices[i : i + 2], joint) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)]
    return matrices[0]


def cheapest(whole: Matrix | None) -> tuple[int, str, tuple[int, ...], tuple[int, ...]]:
    """The best way through a conversation: from nothing, insertions first, to an accepting state."""
    if whole is None:
        return 0, "", (), ()
    ways = []
    for k, lead in enumerate(INSERTIONS[0]):
        for j in (0, 3):
            if lead is not None and (e := whole[k][j]) is not None:
                ways.append((lead[0] + e[0], lead[1] + e[1], (len(lead[1]) + e[2][0], *e[2][1:]) if e[2] else (), e[3]))
    return min(ways)


def repaired(audit: str, state: int, roles: list[str], texts: list[str]) -> list[str]:
    """The lines `role:text` that an audit makes of turns, from a state on."""
    out, at = [], 0
    for letter in audit:
        if letter == "D":
            at += 1
            continue
        initial = roles[at][:1] if letter == "K" else NEXT[state]
        state = STEPS[state, initial]
        role = roles[at] if letter == "K" else ROLES[initial]
        out.append(f"{role}:{'' if letter == 'I' else texts[at]}")
        at += letter != "I"
    return out


class Stretch:
    """What is told of a run of turns in order: counts, ends and the matrix; runs of one conversation add up."""

    NAMES = ("turns", "blank", "duplicate", "truncated", "illegal", "distinct", "low", "high", "first", "last")

    def __init__(self, turns=0, blank=0, duplicate=0, truncated=0, illegal=0, distinct=0, low=None, high=None, first=None, last=None) -> None:
        self.turns, self.blank, self.duplicate, self.truncated, self.illegal = turns, blank, duplicate, truncated, illegal
        self.distinct, self.low, self.high, self.first, self.last = distinct, low, high, first, last

    def values(self) -> tuple:
        return tuple(getattr(self, n) for n in self.NAMES)

    def add(self, o: Stretch) -> Stretch:
        """This run with the one behind it: turns rise, so only the border may share one."""
        if not o.turns:
            return self
        if not self.turns:
            return o
        numbered = [x for x in (self.low, o.low) if x is not None]
        return Stretch(
            self.turns + o.turns, self.blank + o.blank, self.duplicate + o.duplicate, self.truncated + o.truncated,
            self.illegal + o.illegal + (self.last + o.first not in LEGAL),
            self.distinct + o.distinct - (self.high is not None and self.high == o.low),
            min(numbered, default=None), o.high if o.high is not None else self.high, self.first, o.last,
        )

    @property
    def gaps(self) -> int:
        return self.high - self.low + 1 - self.distinct if self.distinct else 0


def stretch(turns: list[tuple]) -> Stretch:
    """Of turns (turn, role, text, fault) in order."""
    faults = [t[3] for t in turns]
    initials = [t[1][:1] for t in turns]
    numbered = [t[0] for t in turns if t[0] is not None]
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
    return Stretch(len(turns), *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, len(set(numbered)), min(numbered, default=None), max(numbered, default=None), *((initials[0], initials[-1]) if turns else (None, None)))


def damaged(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text) with the faults that a number of each turn decides (crc32 of conv_id:turn, modulo 20): 0
    drops it (gone), 1 empties its text, 2 takes its ends of sentences, 3 repeats it (copies), 4 makes it the user's. Nulls
    are one space in role, text and number."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(F.col("_kind").isin(0, 1), "").when(F.col("_kind") == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(shown("role"))
    return rows.withColumn("_kind", kind).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("_kind") == 3, 2).otherwise(1).alias("copies"), (F.col("_kind") == 0).alias("gone"))


def faulty(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text, copies, gone) with fault: blank, duplicate, truncated or none; the first that holds. Of
    repeats at an earlier turn; repeats within one turn are told apart when turns are in order.

    A digest of role and text leads to its first turn; texts move once, and repeats that over one row in 4096 has are
    matched by a broadcast, so no conversation or text gathers in a task."""
    number = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    said = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.octet_length("role").cast("string"), F.concat("role", "text"))
    keyed = turns.withColumn("said", F.when(~F.col("gone"), F.sha2(said, 256)))
    firsts = keyed.where("not gone").groupBy("said").agg(F.min(number).alias("earliest"), F.max(number).alias("latest"), F.count("*").alias("rows"))
    table = stored(firsts.where("earliest <> latest").select("said", F.col("earliest.turn").alias("earliest"), "rows"), "conversation-repeats")
    often = table.where(F.col("rows") > max(1.0, keyed.count() / FREQUENT))
    # a later turn's number is not null, and an earliest null number is before every other
    joined = spread_join(keyed, table.withColumn("repeats", F.lit(True)).drop("rows"), "said", often.withColumn("repeats", F.lit(True)).drop("rows"))
    later = F.col("repeats").isNotNull() & F.col("turn").isNotNull() & (F.col("earliest").isNull() | (F.col("turn") > F.col("earliest")))
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank").when(later, "duplicate").when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated").otherwise("")
    return joined.select("conv_id", "turn", "role", "text", "copies", "gone", fault.alias("fault"))


def _schema(conv: T.DataType) -> T.StructType:
    """Rows of finished conversations (leaf null), or leaves of those that reach over a task's end or are long: their
    turns and their matrix, to be put together."""
    element = "array<struct<cost: long, audit: string, lengths: array<int>, states: array<int>>>"
    fields = T.StructType.fromDDL(f"turns long, blank long, duplicate long, truncated long, illegal long, distinct long, low long, high long, first string, last string, leaf long, matrix {element}, roles array<string>, texts array<string>, cost long, audit string, repaired_sha256 string")
    return T.StructType([T.StructField("conv_id", conv), *fields])


def _flat(m: Matrix) -> list[dict | None]:
    return [None if e is None else {"cost": e[0], "audit": e[1], "lengths": list(e[2]), "states": list(e[3])} for row in m for e in row]


def _square(flat: list[dict | None]) -> Matrix:
    elements = [None if e is None else (e["cost"], e["audit"], tuple(e["lengths"]), tuple(e["states"])) for e in flat]
    return [elements[i : i + 4] for i in range(0, 16, 4)]


def scan(turns: DataFrame, block: int = 4096, size: int = 1 << 20) -> DataFrame:
    """One row for each conversation: its counts, cost, audit and repaired_sha256.

    Turns are sorted over the whole table, so a conversation may reach over many tasks. One that lies within a task, is not its
    first or last and has up to `block` turns and `size` characters is finished there. Of all others each block becomes a
    matrix (a leaf); leaves are multiplied as a tree over parts of the table, the best way is cut into its leaves' audits,
    and each leaf repairs its own turns; one task then reads a conversation's repaired blocks in order, one at a time, as
    its digest needs them.
    """
    kind = turns.schema["conv_id"].dataType
    schema = _schema(kind)
    names = schema.fieldNames()
    # as many parts as a shuffle has: by default about 128 MB each
    ordered = turns.repartitionByRange(F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role")).sortWithinPartitions(F.col("conv_id"), F.col("turn").asc_nulls_first(), "role", "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, out, held, leaf = TaskContext.get().partitionId(), [], 0, 0

        def leaf_of(conv, turns: list[tuple]) -> dict:
            nonlocal leaf
            leaf += 1
            matrix = None
            if turns:
                matrix = [[e and (e[0], e[1], (len(e[1]),), ()) for e in row] for row in product([turn(t[1][:1], t[3]) for t in turns])]
            told = dict(zip(Stretch.NAMES, stretch(turns).values(), strict=True))
            return told | {"conv_id": conv, "leaf": (part << 32) + leaf, "matrix": matrix and _flat(matrix), "roles": [t[1] for t in turns], "texts": [t[2] for t in turns]}

        def whole(conv, turns: list[tuple]) -> dict:
            cost, audit, _, _ = cheapest(product([turn(t[1][:1], t[3]) for t in turns]) if turns else None)
            lines = repaired(audit, 0, [t[1] for t in turns], [t[2] for t in turns])
            told = dict(zip(Stretch.NAMES, stretch(turns).values(), strict=True))
            return told | {"conv_id": conv, "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}

        def pack(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in rows], schema=arrow)

        waiting = None  # the conversation read last: the next one tells that it ended here
        for nth, (conv, group) in enumerate(groupby(rows(batches), key=lambda r: r[0])):
            if waiting:
                out.append(whole(*waiting))
                waiting = None
            turns, chars, before, cut = [], 0, None, nth == 0
            for _, number, role, text, copies, gone, fault in group:
                if gone:
                    continue
                for c in range(copies):
                    again = before == (number, role, text)
                    turns.append((number, role, text, "duplicate" if again and fault != "blank" else fault))
                    before = (number, role, text)
                chars += len(text) * copies
                if len(turns) >= block or chars >= size:
                    out.append(leaf_of(conv, turns))
                    turns, chars, cut = [], 0, True
                    yield pack(out)
                    out = []
            if cut:
                out.append(leaf_of(conv, turns))
                # the last of the task is a leaf too
            else:
                waiting = (conv, turns)
            if len(out) >= 1000:
                yield pack(out)
                out = []
        if waiting:
            out.append(leaf_of(*waiting))
        if out:
            yield pack(out)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    seen = stored(mapped(ordered.select("conv_id", "turn", "role", "text", "copies", "gone", "fault"), run, schema), "conversation-scan")
    done = seen.where("leaf is null")
    leaves = seen.where("leaf is not null")
    long = _long(leaves, schema)
    columns = ["conv_id", *Stretch.NAMES, "cost", "audit", "repaired_sha256"]
    both = done.select(*columns).unionByName(long.select(*columns))
    gaps = F.when(F.col("distinct") > 0, F.col("high") - F.col("low") + 1 - F.col("distinct")).otherwise(0).cast("long")
    return both.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _long(leaves: DataFrame, schema: T.StructType) -> DataFrame:
    """Conversations put together from their leaves."""
    light = [f.name for f in schema if f.name not in ("roles", "texts", "cost", "audit", "repaired_sha256")]
    conv = leaves.schema["conv_id"].dataType
    now = leaves.select(*light, F.array("leaf").alias("leaves"))
    joined = T.StructType([*(f for f in now.schema if f.name != "parts")])
    told = now.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                members = row["members"]
                total = reduce(Stretch.add, (Stretch(*(m[n] for n in Stretch.NAMES)) for m in members))
                full = [m for m in members if m["matrix"]]
                matrix = _flat(product([_square(m["matrix"]) for m in full], joint=True)) if full else None
                out.append(dict(zip(Stretch.NAMES, total.values(), strict=True)) | {"conv_id": members[0]["conv_id"], "leaf": members[0]["leaf"], "matrix": matrix, "leaves": [x for m in full for x in m["leaves"]]})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(joined)
    for shift in (4, 16, 32, 36, 40, 64):  # 16 leaves of a part, all of a part in steps, 16 parts, 256, all
        group = F.shiftright("leaf", shift) if shift < 64 else F.lit(0).cast("long")
        members = F.array_sort(F.collect_list(F.struct("leaf", *(c for c in told if c != "leaf")))).alias("members")
        now = mapped(now.groupBy("conv_id", group.alias("at")).agg(members).select("members"), run, joined)
    now = stored(now, "conversation-tree")

    pieces = T.StructType([T.StructField("conv_id", conv), *T.StructType.fromDDL("leaf long, state int, piece string, cost long, audit string")])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                cost, audit, lengths, states = cheapest(_square(row["matrix"]) if row["matrix"] else None)
                out.append({"conv_id": row["conv_id"], "cost": cost, "audit": audit})
                at = 0
                for leaf, n, state in zip(row["leaves"], lengths, (0, *states), strict=True):
                    out.append({"conv_id": row["conv_id"], "leaf": leaf, "state": state, "piece": audit[at : at + n]})
                    at += n
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in pieces.fieldNames()} for r in out], schema=to_arrow_schema(pieces))

    ways = stored(mapped(now.select("conv_id", "matrix", "leaves"), cut, pieces), "conversation-ways")
    parts = ways.where("leaf is not null").select(F.col("leaf").alias("_leaf"), "state", "piece")
    own = leaves.where("turns > 0").join(parts, F.col("leaf") == F.col("_leaf")).select("conv_id", "leaf", "state", "piece", "roles", "texts")
    lines = T.StructType([T.StructField("conv_id", conv), *T.StructType.fromDDL("leaf long, lines string")])

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            convs, at, told = [], [], []
            for r in batch.to_pylist():
                if made := repaired(r["piece"], r["state"], r["roles"], r["texts"]):
                    convs.append(r["conv_id"])
                    at.append(r["leaf"])
                    told.append("\n".join(made))
            yield pa.RecordBatch.from_arrays([pa.array(convs, to_arrow_schema(lines).field(0).type), pa.array(at, pa.int64()), pa.array(told, pa.string())], names=["conv_id", "leaf", "lines"])

    hashes = T.StructType([T.StructField("conv_id", conv), *T.StructType.fromDDL("repaired_sha256 string")])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)

        kind = to_arrow_schema(hashes).field(0).type
        for c, group in groupby(each(), key=lambda r: r[0]):
            h = hashlib.sha256()
            for i, (_, text) in enumerate(group):
                h.update(b"\n" * (i > 0) + text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([c], kind), pa.array([h.hexdigest()])], names=["conv_id", "repaired_sha256"])

    made = mapped(mapped(own, repair, lines).repartition("conv_id").sortWithinPartitions("conv_id", "leaf"), digest, hashes)
    empty = hashlib.sha256(b"").hexdigest()
    best = ways.where("leaf is null").select(F.col("conv_id").alias("_c"), "cost", "audit")
    made = made.select(F.col("conv_id").alias("_m"), "repaired_sha256")
    both = now.drop("cost", "audit").join(best, F.col("conv_id").eqNullSafe(F.col("_c"))).join(made, F.col("conv_id").eqNullSafe(F.col("_m")), "left")
    return both.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(empty)))


def repair(rows: DataFrame) -> DataFrame:
    """One row for each conv_id of rows(conv_id, turn, role, text), null like any other: gaps between its turns' numbers, turns
    that are blank, repeat an earlier one or are truncated, adjacent roles that are illegal, cost and audit of the cheapest
    edits (K keep, R re-role, D delete, I insert; of equal costs the ASCII-least) and the digest of the repaired turns.

    Turns go by number, nulls first, then by role and text. Nulls in role and text count as one space; other columns are not
    looked at. A conversation without turns (none is given as gone = false) has zeros, no audit and the empty text's digest.
    `rows` may have copies (times that a turn stands there) and gone, as damaged() gives them. Texts are read whole. An empty
    table gives an empty one.
    """
    given = {c.lower() for c in rows.columns}
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    copies = F.col("copies").cast("int") if "copies" in given else F.lit(1)
    gone = F.col("gone").cast("boolean") if "gone" in given else F.lit(False)
    plain = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), shown("role"), shown("text"), copies.alias("copies"), gone.alias("gone"))
    return scan(stored(faulty(plain), "conversation-turns"))


