"""Repair of conversations whose turns are blank, repeated, cut off, out of order or missing, by the cheapest edits.

A conversation's rows are encoded as a compact string, a sign per row for its role's initial and its fault: its signature.
Conversations are many, signatures few: each distinct one is solved once, by memoised recursion over (row, state of the
grammar), and its audit, the string of edits, is joined back and replayed over the rows.

Rows lie in one global order, cut into pieces of SEGMENT rows, so a conversation of any length is a chain of segments. The
state of the grammar is all that passes from one segment to the next: a segment that isn't its conversation's only one is
solved for each state, least costs are folded from the last segment to the first, and states from the first to the last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm import common

#: Bits of a row's place in its segment: segments have 2**SEGMENT_BITS rows at most.
SEGMENT_BITS = 9
#: Costs of edits; a kept or rewritten row that is cut off costs CUT_OFF more.
DELETE, REROLE, INSERT, CUT_OFF = 4, 3, 3, 3
#: States: nothing yet, after system, after user, after assistant. The role that an insertion or a new role gives, and the state after it.
NEEDS, NEXT = ["user", "user", "assistant", "user"], [2, 2, 3, 2]
#: By state and initial, the state after a kept row.
KEEP = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
#: Where a conversation may end, and insertions in a row that can be of use.
ENDS, MOST_INSERTS = (0, 3), 2
#: No way.
NEVER = 1 << 60
FAULTS = ["blank", "duplicate", "truncated"]


def solve(signature: str, togo: list[int] | None) -> list[tuple[int, str, int]]:
    """For each state before the signature's rows: least cost, its ASCII-least audit, and the state after.

    togo: the cost that follows by state after the rows, which the choice takes into account but the cost given doesn't hold;
    None if the conversation ends here, with insertions at the end allowed. A way that doesn't exist costs NEVER and more.
    Signs: d must go; else the initial s, u, a or x (other), in upper case if the row is cut off.
    """
    n = len(signature)

    @cache
    def least(i: int, state: int, spare: int) -> int:
        return min((c for _, c, _ in steps(i, state, spare)), default=NEVER)

    def steps(i: int, state: int, spare: int) -> Iterator[tuple[str, int, tuple[int, int, int] | None]]:
        """(edit, cost to the end, what is left), edits in ASCII order."""
        if i == n:
            if togo is not None:
                yield "", togo[state], None
                return
            if state in ENDS:
                yield "", 0, None
            if spare:
                yield "I", INSERT + least(i, NEXT[state], spare - 1), (i, NEXT[state], spare - 1)
            return
        sign = signature[i]
        extra = CUT_OFF if sign.isupper() else 0
        yield "D", DELETE + least(i + 1, state, MOST_INSERTS), (i + 1, state, MOST_INSERTS)
        if spare:
            yield "I", INSERT + least(i, NEXT[state], spare - 1), (i, NEXT[state], spare - 1)
        if sign != "d":
            after = KEEP[state].get(sign.lower())
            if after is not None:
                yield "K", extra + least(i + 1, after, MOST_INSERTS), (i + 1, after, MOST_INSERTS)
            yield "R", REROLE + extra + least(i + 1, NEXT[state], MOST_INSERTS), (i + 1, NEXT[state], MOST_INSERTS)

    for i in range(n, -1, -1):  # from the end, so that the recursion is never deep
        for state in range(4):
            least(i, state, MOST_INSERTS)
    out = []
    for entry in range(4):
        at, audit = (0, entry, MOST_INSERTS), []
        state = entry
        while at is not None:
            state, cost = at[1], least(*at)
            edit, _, at = next((s for s in steps(*at) if s[1] == cost), ("", 0, None))
            audit.append(edit)
        own = least(0, entry, MOST_INSERTS)
        out.append((own - (togo[state] if togo is not None and own < NEVER else 0), "".join(audit), state))
    return out


def ways(signature: str) -> list[int]:
    """Least costs from each state to each, as 16 numbers."""
    to = [solve(signature, [0 if t == end else NEVER for t in range(4)]) for end in range(4)]
    return [min(to[end][entry][0], NEVER) for entry in range(4) for end in range(4)]


def damaged(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) of rows damaged by crc32(conv:turn) % 20, a null there and in role and text read as one space: 0 drops the row, 1 empties its text, 2 takes its . ! ? out, 3 repeats it, 4 makes its role user."""
    text_of = lambda c: F.coalesce(df[c].cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text_of(conv_col), F.lit(":"), text_of(turn_col))) % 20
    rows = df.select(df[conv_col].alias("conv_id"), df[turn_col].alias("turn"), text_of(role_col).alias("role"), text_of(text_col).alias("text"), kind.alias("kind")).where("kind != 0")
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    twice = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), twice.alias("copy")).drop("copy")


def _ordered(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Stored rows (c, conv, turn, role, text, at, mark, blank, cut): at ascends in the order of conversations and of rows in them; a large conversation lies over several partitions."""
    blanks = F.lit(" \t\n\x0b\x0c\r")
    key = F.coalesce(F.concat(F.lit("="), df[conv_col].cast("string")), F.lit(""))
    role, text = (F.coalesce(df[c].cast("string"), F.lit(" ")) for c in (role_col, text_col))
    rows = df.select(key.alias("c"), df[conv_col].alias("conv"), df[turn_col].cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    last = F.rtrim(F.col("text"), blanks)
    mark = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    rows = rows.withColumns({"mark": mark, "blank": last == "", "cut": ~F.right(last, F.lit(1)).isin(".", "!", "?")})
    # keys of bounded length: what range partitioning samples comes to the driver
    order = [F.col("c"), F.col("turn").asc_nulls_first(), F.substring("role", 1, 64), F.substring("text", 1, 64), F.col("mark")]
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    return common.stored(laid.withColumn("seg", F.shiftright("at", SEGMENT_BITS)), "turns")


def _signatures(rows: DataFrame) -> DataFrame:
    """(c, seg, sig) of each segment."""
    narrow = rows.select("c", "mark", "at", "seg", "blank", "cut", F.substring("role", 1, 1).alias("initial"))
    seen = narrow.where("not blank").groupBy("c", "mark").agg(F.min("at").alias("first"), F.count("*").alias("size")).where("size > 1")
    narrow = common.join_groups(narrow, seen, ["c", "mark"], rows.count(), "at", "left")
    sign = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    sign = F.when(F.col("blank") | (F.col("at") > F.col("first")), "d").when(F.col("cut"), F.upper(sign)).otherwise(sign)
    signed = narrow.select("c", "seg", F.struct("at", sign.alias("sign")).alias("x"))
    return signed.groupBy("c", "seg").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["sign"]), "").alias("sig"))


def _folded(ordered: DataFrame, columns: list[str], schema: str, start: object, step) -> DataFrame:  # noqa: ANN001
    """Over the rows of each conversation, in the order that they are sorted in, (c, seg, what step gives first); step(state, values) gives it and the next state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, start
        for batch in batches:
            c, seg, *rest = (batch.column(j).to_pylist() for j in range(2 + len(columns)))
            out = []
            for i in range(len(c)):
                if c[i] != now:
                    now, state = c[i], start
                given, state = step(state, [r[i] for r in rest])
                out.append(given)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out)], names=["c", "seg", "given"])

    return ordered.select("c", "seg", *columns).mapInArrow(run, f"c string, seg long, given {schema}")


def _solved(segments: DataFrame) -> DataFrame:
    """(c, seg, sig, entry, audit, cost) of stored segments (c, seg, sig)."""

    def all_ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([ways(s) for s in batch.column(0).to_pylist()], pa.list_(pa.int64()))], names=["sig", "ways"])

    def audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, togo = (batch.column(j).to_pylist() for j in range(2))
            found = [solve(s, None if t == "" else [int(x) for x in t.split(",")]) for s, t in zip(sig, togo, strict=True)]
            columns = [pa.array([[w[k] for w in f] for f in found], pa.list_(kind)) for k, kind in enumerate((pa.int64(), pa.string(), pa.int64()))]
            yield pa.record_batch([batch.column(0), batch.column(1), *columns], names=["sig", "togo", "costs", "audits", "exits"])

    total = segments.count()
    long = segments.groupBy("c").agg(F.count("*").alias("size"), F.max("seg").alias("last")).where("size > 1")
    placed = common.stored(common.join_groups(segments, long, ["c"], total, "seg", "left"), "placed")
    # chains: what is to follow each segment, by state, less what every state has
    chained = placed.where("last is not null")
    shapes = chained.groupBy("sig").agg(F.count("*").alias("size"))
    cost = shapes.select("sig").mapInArrow(all_ways, "sig string, ways array<bigint>").join(shapes, "sig")
    chained = common.join_groups(chained, cost, ["sig"], total, "seg")

    def before(togo: list[int], values: list) -> tuple[str, list[int]]:
        way, ends = values
        if ends:
            togo = [0 if s in ENDS else INSERT * (3 - s) for s in range(4)]
        low = min(togo)
        then = [min(way[4 * s + t] + togo[t] for t in range(4)) for s in range(4)]
        return "" if ends else ",".join(str(x - low) for x in togo), [x - min(then) for x in then]

    back = chained.withColumn("ends", F.col("seg") == F.col("last")).repartition("c").sortWithinPartitions("c", F.desc("seg"))
    back = _folded(back, ["ways", "ends"], "string", [0, 0, 0, 0], lambda togo, v: before(togo, [v[0], v[1]]))
    asked = placed.join(back.withColumnRenamed("given", "togo"), ["c", "seg"], "left").withColumn("togo", F.coalesce("togo", F.lit("")))
    asked = common.stored(asked.select("c", "seg", "sig", "togo", F.col("last").isNotNull().alias("chained")), "asked")
    cases = asked.groupBy("sig", "togo").agg(F.count("*").alias("size"))
    found = cases.select("sig", "togo").mapInArrow(audits, "sig string, togo string, costs array<bigint>, audits array<string>, exits array<bigint>").join(cases, ["sig", "togo"])
    out = common.stored(common.join_groups(asked, found, ["sig", "togo"], total, "seg"), "solved")
    on = out.where("chained").repartition("c").sortWithinPartitions("c", "seg")
    on = _folded(on, ["exits"], "long", 0, lambda state, v: (state, v[0][state]))
    out = out.join(on.withColumnRenamed("given", "entry"), ["c", "seg"], "left").withColumn("entry", F.coalesce("entry", F.lit(0)))
    return out.select("c", "seg", "sig", "entry", F.get("audits", F.col("entry").cast("int")).alias("audit"), F.get("costs", F.col("entry").cast("int")).alias("cost"))


def _replayed(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """Rows and, before those of each segment, its solution, in order, each conversation in one task, which streams through it."""
    none = lambda kind: F.lit(None).cast(kind)
    heads = solved.select("c", "seg", F.lit(-1).cast("long").alias("at"), none(rows.schema["conv"].dataType).alias("conv"), F.col("entry").alias("turn"), "sig", F.col("audit").alias("text"), "cost")
    lines = rows.select("c", "seg", "at", "conv", "turn", F.col("role").alias("sig"), "text", none("long").alias("cost"))
    return heads.unionByName(lines).repartition("c").sortWithinPartitions("c", "seg", "at")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of replayed rows: ("open",) for each conversation, ("cost", cost, audit) for each segment, ("row", conv, fault, turn, role) for each row, ("edit", edit, role, text, turn) for each edit."""
    now, state, audit, place, sig, at = None, 0, "", 0, "", 0

    def inserted() -> Iterator[tuple]:
        nonlocal state, place
        while audit[place : place + 1] == "I":
            yield "edit", "I", NEEDS[state], "", None
            state, place = NEXT[state], place + 1

    for batch in batches:
        for c, _, k, conv, turn, role, text, cost in zip(*(batch.column(j).to_pylist() for j in range(8)), strict=True):
            if k < 0:
                if c != now:
                    now = c
                    yield ("open",)
                state, sig, audit, place, at = turn, role, text, 0, 0
                yield "cost", cost, audit
                continue
            sign = sig[at]
            fault = "truncated" if sign.isupper() else None
            if sign == "d":
                fault = "duplicate" if text.strip(" \t\n\x0b\x0c\r") else "blank"
            yield "row", conv, fault, turn, role
            yield from inserted()
            edit = audit[place]
            place, at = place + 1, at + 1
            if edit == "R":
                role = NEEDS[state]
            yield "edit", edit, role, text, turn
            if edit != "D":
                state = NEXT[state] if edit == "R" else KEEP[state][role[0]]
            if at == len(sig):
                yield from inserted()


class _Audit:
    """What is known of a conversation so far."""

    def __init__(self) -> None:
        self.conv, self.spent, self.audit = None, 0, []
        self.counts, self.illegal, self.last = dict.fromkeys(FAULTS, 0), 0, None
        self.turns, self.low, self.high = 0, None, None
        self.digest, self.begun = hashlib.sha256(), False

    def cost(self, cost: int, audit: str) -> None:
        self.spent += cost
        self.audit.append(audit)

    def row(self, conv: object, fault: str | None, turn: int | None, role: str) -> None:
        self.conv = conv
        if fault:
            self.counts[fault] += 1
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        if self.last is not None and self.last + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = role[:1]

    def edit(self, edit: str, role: str, text: str, turn: int | None) -> None:
        if edit != "D":
            self.digest.update((("\n" if self.begun else "") + f"{role}:{text}").encode())
            self.begun = True

    def values(self) -> tuple:
        gaps = 0 if self.high is None else self.high - self.low + 1 - self.turns
        return self.conv, gaps, *self.counts.values(), self.illegal, self.spent, "".join(self.audit), self.digest.hexdigest()


NUMBERS = ["gaps", *FAULTS, "illegal", "cost"]


def _solution(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    common.ship(df.sparkSession)
    rows = _ordered(df, conv_col, turn_col, role_col, text_col)
    return _replayed(rows, _solved(common.stored(_signatures(rows), "segments")))


def _batches(rows: Iterator[tuple], types: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    """Rows as batches of BATCH_ROWS."""
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), types, strict=True)], names=[n for n, _ in types])

    for r in rows:
        held.append(r)
        if len(held) == common.BATCH_ROWS:
            yield batch()
            held = []
    if held:
        yield batch()


def audits(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row per conversation: conv_col, gaps, blank, duplicate, truncated, illegal, cost (longs), audit, repaired_sha256.

    Rows are in turn order, null first; rows of one turn by role, then text. Null roles and texts are one space, and rows of
    a null conversation are one conversation. A row's first fault counts: blank (only white space), duplicate (role and
    text are those of a row before it, by SHA-256), truncated (its last sign isn't . ! or ?). gaps: turns that are missing
    between the first and the last; illegal: neighbours whose roles' initials aren't su, ua or au. Edits: (K)eep 0, (R)erole
    to user or assistant 3, (D)elete 4, the only one for blank and duplicate rows, (I)nsert an empty user or assistant 3; a
    truncated row that stays costs 3 more. audit has the cheapest edits' initials that leave roles of the form (s?(ua)+)?, the
    ASCII-least of equal cost; repaired_sha256 is of what is left, role:text, joined by line ends. Other columns aren't read. An
    empty table gives no rows. SHA-256 has no parts, so one task streams through a conversation's rows, in bounded memory
    but for its audit.
    """
    kind = df.schema[conv_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return

        def found() -> Iterator[tuple]:
            own = None
            for what, *v in _edited(chain([first], batches)):
                if what == "open":
                    if own:
                        yield own.values()
                    own = _Audit()
                else:
                    getattr(own, what)(*v)
            if own:
                yield own.values()

        yield from _batches(found(), [("_id", first.schema.field(3).type), *((n, pa.int64()) for n in NUMBERS), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    out = _solution(df, conv_col, turn_col, role_col, text_col).mapInArrow(run, f"_id {kind.simpleString()}, {', '.join(n + ' long' for n in NUMBERS)}, audit string, repaired_sha256 string")
    return common.named(out, conv_col, [*NUMBERS, "audit", "repaired_sha256"])


def repaired(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows of the repaired conversations: conv_col, place (from 0 in its conversation), turn (null for an inserted row), role, text, edit (I, K or R). Conversations of which nothing is left have none. For the rest see audits."""
    kind = df.schema[conv_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return

        def found() -> Iterator[tuple]:
            conv, place = None, 0
            for what, *v in _edited(chain([first], batches)):
                if what == "open":
                    place = 0
                elif what == "row":
                    conv = v[0]
                elif what == "edit" and v[0] != "D":
                    edit, role, text, turn = v
                    yield conv, place, turn, role, text, edit
                    place += 1

        yield from _batches(found(), [("_id", first.schema.field(3).type), ("place", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])

    out = _solution(df, conv_col, turn_col, role_col, text_col).mapInArrow(run, f"_id {kind.simpleString()}, place long, turn long, role string, text string, edit string")
    return common.named(out, conv_col, ["place", "turn", "role", "text", "edit"])
