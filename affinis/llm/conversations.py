"""Repair of conversation structure: cheapest edits by a Viterbi search that emits them as it goes.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``. Rows are kept (0),
given the role user or assistant (1) or deleted (2), and user or assistant rows without text are
inserted (5); blank and repeated rows must go, and a truncated row that stays costs 5 more. Of
equally cheap edits those whose initials (K, R, D, I) come first in ASCII order are taken.

Rows of a conversation stream through one search in order of their turns. For each state of the
pattern the search holds one survivor, the tip of a path in a tree of back pointers that counts
references: a node goes when no path uses it, and where all survivors share an ancestor, the edits
up to it are final, leave the task and are forgotten. Equally cheap paths are compared over their
whole unresolved parts, by the order of the survivors that they go on from and the edits since. A
survivor that another one beats even after the edits that lead over to its state is dropped; without
this, the path that deletes every row would survive to the end. So a task holds the unresolved part
of one conversation, not the conversation. That part is short unless the answer itself hangs on the
end, as where all rows have one role and their number decides whether the first one goes. Earlier
copies of a row are found by a window sort that spills, not by a set in memory.

One conversation is one stream: its digest is a hash over its rows in order, which can't be split.

Defined results: null role and text are one space each, so such a text is blank; rows without
conv_id are one conversation; rows without turn come first. Rows of one turn are taken in order of
role and text. A role without characters fits nowhere and is changed or deleted. Repeated rows are
duplicates. An empty table gives an empty result. Columns other than conv_id, turn, role and text
take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from affinis.llm.common import in_small_batches

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Where an initial leads from a state: 0 nothing yet, 1 after s, 2 after u, 3 after a. 0 and 3 may end.
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_ENDS = (0, 3)
#: The role that a state takes from an edit that may choose it, and where that leads.
_WANTS = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
#: At most this much more a survivor of the second state may cost than one of the first to stay: what leads from
#: the first to whatever the second can do. From 3, a system row that 0 keeps is deleted; from 0 what 1 does can be done as it is.
_BRIDGES = {
    (3, 0): DELETE, (2, 0): INSERT + DELETE, (1, 0): 2 * INSERT + DELETE,
    (3, 1): 0, (2, 1): INSERT, (0, 1): 0,
    (3, 2): INSERT, (0, 2): INSERT, (1, 2): INSERT,
    (2, 3): INSERT, (0, 3): 0,
}
#: Rows of a batch that leaves a task, and the characters of text after which it leaves earlier.
OUT_ROWS, OUT_TEXT = 1000, 4 << 20


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with planted faults, chosen by crc32(``conv_id:turn``) modulo 20; see the cases below."""
    name = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv_id", "", "turn")])
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        (F.crc32(name.cast("binary")) % 20).alias("fault"),
    ).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def _seen_twice() -> Column:
    return F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1


def faults(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, fault; conversations whole and in order within the partitions."""
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")
    ).repartition("conv_id")
    fault = (
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank")
        .when(_seen_twice(), "duplicate")
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    )
    first = F.col("fault").eqNullSafe("duplicate")  # of equal rows
    return rows.withColumn("fault", fault).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", first)


class _Node:
    """An edit at the end of a path; ``uses`` counts the paths that go on from here and survivors that end here.

    ``order`` compares whole paths: the place, among the survivors of the last row, of the one that the path goes
    on from, and the edits since. No survivor's edits begin those of another, as both have used the same rows.
    """

    __slots__ = ("before", "edit", "role", "row", "cost", "uses", "order")

    def __init__(self, before, edit, role, row, cost) -> None:
        self.before, self.edit, self.role, self.row, self.cost, self.uses = before, edit, role, row, cost, 0
        self.order = (0, "")
        if before is not None:
            before.uses += 1
            self.order = (before.order[0], before.order[1] + edit)


def _release(node) -> None:
    while node is not None and node.uses == 0:
        node, gone = node.before, node
        gone.before = None
        if node is not None:
            node.uses -= 1


class Search:
    """The cheapest edits of one conversation. ``add`` takes a row and ``end`` closes; both return the edits that are now final."""

    def __init__(self) -> None:
        self.root = _Node(None, "", None, None, 0)
        self.root.uses = 1
        self.tips = {0: self.root}

    def _offer(self, tips: dict, state: int, before, edit: str, role, row, cost: int) -> None:
        held = tips.get(state)
        if held is not None and held.cost < cost:
            return
        node = _Node(before, edit, role, row, cost)
        if held is not None and held.cost == cost and held.order < node.order:
            _release(node)
            return
        node.uses += 1
        tips[state] = node
        if held is not None:
            held.uses -= 1
            _release(held)

    def _insert(self) -> None:
        for _ in range(2):
            for state in list(self.tips):
                role, to = _WANTS[state]
                tip = self.tips[state]
                self._offer(self.tips, to, tip, "I", role, None, tip.cost + INSERT)

    def add(self, row: tuple, initial: str, fault: str | None) -> list:
        """``row`` comes back with its edit; ``initial`` is that of its role."""
        self._insert()
        old, new = self.tips, {}
        more = TRUNCATED if fault == "truncated" else 0
        for state, tip in old.items():
            self._offer(new, state, tip, "D", None, row, tip.cost + DELETE)
            if fault not in ("blank", "duplicate"):
                to = _NEXT.get((state, initial))
                if to is not None:
                    self._offer(new, to, tip, "K", None, row, tip.cost + KEEP + more)
                role, to = _WANTS[state]
                self._offer(new, to, tip, "R", role, row, tip.cost + REROLE + more)
        for (better, worse), bridge in _BRIDGES.items():
            if better in new and worse in new and new[better].cost + bridge < new[worse].cost:
                gone = new.pop(worse)
                gone.uses -= 1
                _release(gone)
        self.tips = new
        for tip in old.values():
            tip.uses -= 1
            _release(tip)
        for place, tip in enumerate(sorted(new.values(), key=lambda tip: tip.order)):
            tip.order = (place, "")
        return self._final() if self.root.uses == 1 else []

    def _final(self, whole: bool = False) -> list:
        path, node = [], next(iter(self.tips.values()))
        while node is not self.root:
            path.append(node)
            node = node.before
        out = []
        for node in reversed(path):
            if self.root.uses != 1 and not whole:
                break
            node.before, self.root = None, node
            out.append((node.edit, node.role, node.row, node.cost))
        return out

    def end(self) -> list:
        self._insert()
        best = min((self.tips[s] for s in _ENDS if s in self.tips), key=lambda tip: (tip.cost, tip.order))
        self.tips = {0: best}
        return self._final(whole=True)


def _edits(batches: Iterable) -> Iterator:
    import pyarrow as pa

    names = ["conv_id", "step", "edit", "cost", "turn", "fault", "role", "repaired_role", "text"]
    held: list[tuple] = []
    chars = 0
    search, conv, step, paid, kinds = None, None, 0, 0, None

    def table(rows: list[tuple]):
        columns = list(zip(*rows))
        types = [kinds[0], pa.int64(), pa.string(), pa.int64(), kinds[1], *[pa.string()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    def told(final: list) -> None:
        nonlocal step, paid, chars
        for edit, role, row, cost in final:
            step += 1
            turn, own, text, fault = row or (None, None, "", None)
            held.append((conv, step, edit, cost - paid, turn, fault, own, None if edit == "D" else role or own, text))
            paid, chars = cost, chars + len(text)

    for batch in batches:
        kinds = batch.schema.field("conv_id").type, batch.schema.field("turn").type
        for own, turn, role, text, fault in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault")]):
            if search is None or own != conv:
                if search is not None:
                    told(search.end())
                search, conv, step, paid = Search(), own, 0, 0
            told(search.add((turn, role, text, fault), role[:1], fault))
            if len(held) >= OUT_ROWS or chars >= OUT_TEXT:
                yield table(held)
                held, chars = [], 0
    if search is not None:
        told(search.end())
    if held:
        yield table(held)


def repair(conversations: DataFrame) -> DataFrame:
    """The edits of every conversation, whole and in order within the partitions.

    conv_id, step (from 1), edit, cost; turn, fault and role of the row (null for inserted ones), the
    repaired_role (null for deleted ones) and text. Rows that are not deleted are the repaired conversation.
    """
    kinds = {f.name: f.dataType for f in conversations.schema}
    more = [("step", LongType()), ("edit", StringType()), ("cost", LongType()), ("turn", kinds["turn"])]
    more += [(c, StringType()) for c in ("fault", "role", "repaired_role", "text")]
    schema = StructType([StructField("conv_id", kinds["conv_id"]), *[StructField(n, t) for n, t in more]])
    return in_small_batches(faults(conversations)).mapInArrow(_edits, schema)


class _Report:
    """What is told of one conversation, from its edits in order."""

    def __init__(self) -> None:
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.illegal = self.cost = self.turns = 0
        self.least = self.last = self.initial = None
        self.audit: list[str] = []
        self.hash, self.empty = hashlib.sha256(), True

    def add(self, edit, cost, turn, fault, role, repaired_role, text) -> None:
        self.audit.append(edit)
        self.cost += cost
        if edit != "I":
            if fault:
                self.counts[fault] += 1
            if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.initial = role[:1]
            if turn is not None:
                self.least = turn if self.least is None else self.least
                self.turns += turn != self.last
                self.last = turn
        if edit != "D":
            self.hash.update(f"{'' if self.empty else chr(10)}{repaired_role}:{text}".encode())
            self.empty = False

    def row(self) -> tuple:
        gaps = 0 if self.least is None else self.last - self.least + 1 - self.turns
        return gaps, *self.counts.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


def _reports(batches: Iterable) -> Iterator:
    import pyarrow as pa

    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    report, conv, rows = None, None, []

    def table():
        columns = list(zip(*rows))
        types = [kind, *[pa.int64()] * len(numbers), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["conv_id", *numbers, "audit", "repaired_sha256"])

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for own, step, *rest in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "step", "edit", "cost", "turn", "fault", "role", "repaired_role", "text")]):
            if step == 1:
                if report is not None:
                    rows.append((conv, *report.row()))
                report, conv = _Report(), own
            report.add(*rest)
        if len(rows) >= OUT_ROWS:
            yield table()
            rows = []
    if report is not None:
        rows.append((conv, *report.row()))
    if rows:
        yield table()


def reports(edits: DataFrame, conv_ids: DataFrame) -> DataFrame:
    """One row for each conversation of ``conv_ids``, from the edits that ``repair`` returned (same order, same partitions).

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. A conversation
    without rows has zeros, an empty audit and the hash of nothing.
    """
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = StructType([edits.schema["conv_id"], *[StructField(n, LongType()) for n in numbers], StructField("audit", StringType()), StructField("repaired_sha256", StringType())])
    told = edits.mapInArrow(_reports, schema)
    ids = conv_ids.select(F.col("conv_id").alias("_conv")).distinct()
    return ids.join(told, F.col("_conv").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("_conv").alias("conv_id"), *[F.coalesce(n, F.lit(0)).alias(n) for n in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
