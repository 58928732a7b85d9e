"""Repair of the structure of conversations by weighted edits that a generalised LR parser chooses.

The roles of a conversation must read as an optional system turn and pairs of user and assistant, or
be empty. Turns may be kept, given another role or deleted, and empty turns be inserted. The parser
reads the turns from left to right with all edits at once: its stacks share their tails and form a
graph, and stacks with equal tops are merged into the one of least (cost, audit), so that a turn costs
a fixed number of steps. The audit is the sequence of the initials of the edits; equal costs are
decided by it, least first.

Merging by the top alone is right where equal tops allow the same continuations; this is checked when
the grammar is compiled. No audit of equal cost and top is the start of the other, as every further
edit before the same turn is an insertion and costs something, so what is least now stays least.

Turns are dealt out by range of (conversation, turn), so a conversation with a third of all turns
lies in many ranges. A range that does not see the beginning of a conversation parses it from every
possible top; the answers, one row for each range and conversation, are then put together in order.
Only positions, flags and edits take part in this. Texts are stored in order once and meet their edits
by position.

* A null in role or text counts as one space, a null turn comes first, a null conversation is one.
* Equal turns are ordered by role and hash of the text; rows that are repeated wholly are turns of
  their own, all but the first duplicates.
* Empty and blank texts are faults; texts of any length are only looked at by their end and hash.
* No rows give no report and no turns. Columns besides the four are left out.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from burdenlens.llm.common import BREAKS, arrow
from burdenlens.workspace import stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: A conversation, as rules of role initials: nothing, or pairs, or a system turn and pairs.
RULES = (
    ("talk", ()),
    ("talk", ("pairs",)),
    ("talk", ("s", "pairs")),
    ("pairs", ("u", "a")),
    ("pairs", ("pairs", "u", "a")),
)
#: Roles that turns may be given.
GIVEN = {"u": "user", "a": "assistant"}
#: Neighbours that may follow each other.
LEGAL = frozenset({"su", "ua", "au"})

#: A way to a stack top: cost, audit, and for each edit the initial of a given role or a dash.
Way = tuple[int, str, str]


class Grammar:
    """Tables of a generalised LR parser for roles.

    ``after[top][initial]`` are the tops that reading a role leads to, ``final`` those at which a
    conversation may end and ``start`` the first. States are sets of LR(0) items; where a state can
    both reduce and shift, both are followed. Stacks are cells of a state and the cell below it, so
    stacks share their tails. The cells must be finite in number, as for a left-linear grammar.
    """

    def __init__(self, rules=RULES, limit: int = 1000):
        self.rules = rules
        self.heads = {head for head, _ in rules}
        roles = sorted({s for _, body in rules for s in body if s not in self.heads})
        goal = rules[0][0]
        first = self._closed({(k, 0) for k, (head, _) in enumerate(rules) if head == goal})
        bottom = (first, None)
        cells, moves, ends = [bottom], {}, {}
        for cell in cells:  # grows as cells are found
            reduced = self._reduced(cell)
            ends[cell] = any(c[1] == bottom and c[0] == goal for c in reduced)
            for role in roles:
                shifted = {
                    (state, c) for c in reduced if not isinstance(c[0], str)
                    for state in [self._goto(c[0], role)] if state
                }
                moves[cell, role] = shifted
                cells += [c for c in sorted(shifted, key=repr) if c not in cells]
            if len(cells) > limit:
                raise ValueError("the grammar needs stacks of any depth")
        tops = {state: k for k, state in enumerate(dict.fromkeys(c[0] for c in cells))}
        top = {cell: tops[cell[0]] for cell in cells}
        self.start = top[bottom]
        self.final = {top[c] for c in cells if ends[c]}
        self.after: list[dict[str, tuple[int, ...]]] = [{} for _ in tops]
        for cell in cells:
            if (top[cell] in self.final) != ends[cell]:
                raise ValueError("stacks with equal tops do not end alike")
            for role in roles:
                to = tuple(sorted({top[c] for c in moves[cell, role]}))
                if self.after[top[cell]].setdefault(role, to) != to:
                    raise ValueError("stacks with equal tops do not go on alike")

    def _closed(self, items) -> frozenset:
        items, old = set(items), None
        while items != old:
            old = set(items)
            for rule, dot in old:
                body = self.rules[rule][1]
                if dot < len(body):
                    items |= {(k, 0) for k, (head, _) in enumerate(self.rules) if head == body[dot]}
        return frozenset(items)

    def _goto(self, state: frozenset, symbol: str) -> frozenset:
        return self._closed(
            (rule, dot + 1)
            for rule, dot in state
            if dot < len(self.rules[rule][1]) and self.rules[rule][1][dot] == symbol
        )

    def _reduced(self, cell) -> list:
        """The cell and all that reductions make of it; the goal itself is (goal, bottom)."""
        found = [cell]
        for state, below in found:
            if isinstance(state, str):
                continue
            for rule, dot in state:
                head, body = self.rules[rule]
                if dot < len(body):
                    continue
                base = (state, below)
                for _ in body:
                    base = base[1]
                if head == self.rules[0][0]:
                    new = (head, base)
                else:
                    new = (self._goto(base[0], head), base)
                if new not in found:
                    found.append(new)
        return found


class Parser:
    """The front of the graph of stacks while turns are read: the least way to every top."""

    def __init__(self, grammar: Grammar, top: int):
        self.grammar = grammar
        self.front: dict[int, Way] = {top: (0, "", "")}
        self.done: list[tuple[str, str]] = []  # what all ways have in common and no longer carry
        self.read = 0

    def inserted(self) -> None:
        """Follows insertions from every top until none finds a lesser way."""
        todo = list(self.front)
        while todo:
            top = todo.pop()
            cost, audit, roles = self.front[top]
            for role in GIVEN:
                way = (cost + INSERT, audit + "I", roles + role)
                for to in self.grammar.after[top].get(role, ()):
                    if to not in self.front or way < self.front[to]:
                        self.front[to] = way
                        todo.append(to)

    def turn(self, initial: str, must_go: bool, truncated: bool) -> None:
        """Reads a turn with all edits."""
        self.inserted()
        new: dict[int, Way] = {}

        def reach(tops, way: Way) -> None:
            for to in tops:
                if to not in new or way < new[to]:
                    new[to] = way

        more = TRUNCATED if truncated else 0
        for top, (cost, audit, roles) in self.front.items():
            reach((top,), (cost + DELETE, audit + "D", roles + "-"))
            if must_go:
                continue
            after = self.grammar.after[top]
            reach(after.get(initial, ()), (cost + KEEP + more, audit + "K", roles + "-"))
            for role in GIVEN:
                reach(after.get(role, ()), (cost + REROLE + more, audit + "R", roles + role))
        self.front = new
        self.read += 1
        if self.read % 64 == 0:
            self._settle()

    def _settle(self) -> None:
        """Puts aside what all audits begin with, so that they stay short."""
        size = len(os.path.commonprefix([a for _, a, _ in self.front.values()]))
        size = min(size, len(os.path.commonprefix([r for _, _, r in self.front.values()])))
        if size:
            _, audit, roles = next(iter(self.front.values()))
            self.done.append((audit[:size], roles[:size]))
            self.front = {t: (c, a[size:], r[size:]) for t, (c, a, r) in self.front.items()}

    def ways(self) -> dict[int, Way]:
        """The least way to every top, whole."""
        audit, roles = ("".join(x) for x in zip(*self.done, strict=True)) if self.done else ("", "")
        return {t: (c, audit + a, roles + r) for t, (c, a, r) in self.front.items()}


class Repair(NamedTuple):
    """``turns``: ``conv_id, place, step, edit, role, text`` of what is kept or inserted, ordered by
    place and step; ``report``: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``."""

    turns: DataFrame
    report: DataFrame


def repair(turns: DataFrame) -> Repair:
    """The cheapest repair of every conversation of ``conv_id, turn, role, text``."""
    ordered = _ordered(turns)
    kind = dict(ordered.dtypes)["conv_id"]
    flagged = _flagged(ordered)
    plan = stored(_joined(_parsed(flagged, kind), kind), "repair-plan")
    whole = plan.where("audit IS NOT NULL").drop("_part", "_first", "edits")
    turn = F.col("turn")
    gaps = ordered.groupBy("conv_id").agg(
        F.coalesce(F.max(turn) - F.min(turn) + 1 - F.countDistinct(turn), F.lit(0))
        .cast("bigint").alias("gaps")
    )
    report = whole.join(
        gaps.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv"))
    )
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    return Repair(_applied(ordered, plan), report.select("conv_id", "gaps", *counts, "audit"))


def _ordered(turns: DataFrame) -> DataFrame:
    """All turns in order, stored: ``conv_id, turn, role, text``, their ``_part``, ``_row`` and
    ``_key``, which is the same for equal role and text of a conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    conv = F.coalesce(F.concat(F.col("conv_id").cast("string"), F.lit(":")), F.lit("-"))
    parts = F.concat(conv, F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = turns.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), F.unhex(F.sha2(parts, 256)).alias("_key")
    ).withColumn("_id", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "role", "_key", "_id"]  # never the text: bounds go to the driver
    ranged = (
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    )
    return stored(ranged.drop("_id"), "repair-order")


def _flagged(ordered: DataFrame) -> DataFrame:
    """Positions with ``initial, blank, ended`` and, as rows of their own before them, the positions
    whose role and text stood earlier in the conversation."""
    place = F.struct("_part", "_row")
    shown = F.rtrim("text", F.lit(" " + BREAKS))
    slim = ordered.select(
        "conv_id",
        "_part",
        "_row",
        F.lit(1).alias("_kind"),
        F.substring("role", 1, 1).alias("initial"),
        (shown == "").alias("blank"),
        F.substring(shown, -1, 1).isin(".", "!", "?").alias("ended"),
    )
    seen = ordered.groupBy("_key").agg(F.min(place).alias("_earliest"), F.count("*").alias("_n"))
    again = ordered.join(seen.where("_n > 1"), "_key").where(place > F.col("_earliest"))
    marks = again.select("conv_id", "_part", "_row", F.lit(0).alias("_kind"))
    return slim.unionByName(marks, allowMissingColumns=True)


def _parsed(flagged: DataFrame, kind: str) -> DataFrame:
    """For each range and conversation in it: counts, first and last initial, and the ways through."""
    dealt = flagged.repartition("_part").sortWithinPartitions("_part", "_row", "_kind")
    grammar = Grammar()
    names = ["_part", "conv_id", "_row", "_kind", "initial", "blank", "ended"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = None  # (part, conversation)
        marked = None
        for batch in batches:
            out = []
            columns = [batch.column(n).to_pylist() for n in names]
            for part, conv, row, kind_, initial, blank, ended in zip(*columns, strict=True):
                if kind_ == 0:
                    marked = (part, row)
                    continue
                if current is None or current.key != (part, conv):
                    if current is not None:
                        out.append(current.row())
                    begins = row == 0 and part != 0
                    current = _Range(grammar, part, conv, row, begins)
                current.turn(initial, blank, marked == (part, row), ended)
            if out:
                yield _rows(out, schema)
        if current is not None:
            yield _rows([current.row()], schema)

    spelled = (
        f"conv_id {kind}, _part int, _first bigint, blank bigint, duplicate bigint, truncated bigint,"
        " illegal bigint, head string, tail string,"
        " ways array<struct<origin: int, top: int, cost: bigint, audit: string, roles: string>>"
    )
    schema = _arrow_schema(flagged, spelled)
    return arrow(dealt.select(*names), run, spelled)


class _Range:
    """What a range holds of a conversation. Only a conversation at the start of a range may have
    begun in an earlier one, so only that one is parsed from every top."""

    def __init__(self, grammar: Grammar, part: int, conv, row: int, may_go_on: bool):
        self.key, self.first = (part, conv), row
        tops = range(len(grammar.after)) if may_go_on else [grammar.start]
        self.parsers = {top: Parser(grammar, top) for top in tops}
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.head = self.tail = None

    def turn(self, initial: str, blank: bool, again: bool, ended: bool) -> None:
        duplicate = again and not blank
        truncated = not (blank or duplicate or ended)
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        if self.tail is None:
            self.head = initial
        else:
            self.illegal += self.tail + initial not in LEGAL
        self.tail = initial
        for parser in self.parsers.values():
            parser.turn(initial, blank or duplicate, truncated)

    def row(self) -> tuple:
        ways = [
            {"origin": origin, "top": top, "cost": cost, "audit": audit, "roles": roles}
            for origin, parser in self.parsers.items()
            for top, (cost, audit, roles) in parser.ways().items()
        ]
        part, conv = self.key
        counts = (self.blank, self.duplicate, self.truncated, self.illegal)
        return (conv, part, self.first, *counts, self.head, self.tail, ways)


def _joined(parsed: DataFrame, kind: str) -> DataFrame:
    """The chosen edits of each range of a conversation; its last row has the counts, cost and audit
    of the whole conversation, the others have none."""
    dealt = parsed.repartition("conv_id").sortWithinPartitions("conv_id", "_part")
    grammar = Grammar()
    counted = ["blank", "duplicate", "truncated", "illegal"]

    def finished(ranges: list[dict]) -> list[tuple]:
        front: dict[int, Way] = {grammar.start: (0, "", "")}
        back: list[dict[int, tuple[int, dict]]] = []
        for r in ranges:
            new: dict[int, Way] = {}
            came = {}
            for w in r["ways"]:
                if w["origin"] not in front:
                    continue
                cost, audit, roles = front[w["origin"]]
                way = (cost + w["cost"], audit + w["audit"], roles + w["roles"])
                if w["top"] not in new or way < new[w["top"]]:
                    new[w["top"]], came[w["top"]] = way, (w["origin"], w)
            front = new
            back.append(came)
        end = Parser(grammar, grammar.start)
        best = None
        for top, way in front.items():
            end.front = {top: (0, "", "")}
            end.inserted()
            for last, (cost, audit, roles) in end.front.items():
                whole = (way[0] + cost, way[1] + audit, way[2] + roles)
                if last in grammar.final and (best is None or whole < best[0]):
                    best = (whole, top, audit, roles)
        (cost, audit, _), top, more, more_roles = best
        edits = []
        for came in reversed(back):
            top, w = came[top]
            edits.append(_by_turn(w["audit"] + more, w["roles"] + more_roles))
            more = more_roles = ""
        edits.reverse()
        totals = [sum(r[c] for r in ranges) for c in counted]
        totals[3] += sum(a["tail"] + b["head"] not in LEGAL for a, b in zip(ranges, ranges[1:]))
        out = [
            (r["conv_id"], r["_part"], r["_first"], e, *[None] * 6)
            for r, e in zip(ranges, edits, strict=True)
        ]
        out[-1] = (*out[-1][:4], *totals, cost, audit)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges: list[dict] = []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if ranges and ranges[0]["conv_id"] != row["conv_id"]:
                    out += finished(ranges)
                    ranges = []
                ranges.append(row)
            if out:
                yield _rows(out, schema)
        if ranges:
            yield _rows(finished(ranges), schema)

    spelled = (
        f"conv_id {kind}, _part int, _first bigint, edits array<string>, blank bigint,"
        " duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
    )
    schema = _arrow_schema(parsed, spelled)
    return arrow(dealt, run, spelled)


def _by_turn(audit: str, roles: str) -> list[str]:
    """Edits and given roles, in turns, for each turn with the insertions before it; the last turn has
    those after it as well."""
    pairs = "".join(map("".join, zip(audit, roles, strict=True)))
    turns = [m[0] for m in re.finditer(r"(?:I.)*[KRD].", pairs)]
    turns[-1] += pairs[sum(map(len, turns)) :]
    return turns


def _applied(ordered: DataFrame, plan: DataFrame) -> DataFrame:
    """The turns that the edits leave."""
    edits = plan.select(
        F.col("_part").alias("_in"), "_first", F.posexplode("edits").alias("_k", "steps")
    ).select("_in", (F.col("_first") + F.col("_k")).alias("_at"), "steps")
    met = ordered.join(edits, (F.col("_part") == F.col("_in")) & (F.col("_row") == F.col("_at")))
    places = F.sequence(F.lit(0), F.floor(F.length("steps") / 2).cast("int") - 1)
    each = met.withColumn("step", F.explode(places)).withColumns(
        {
            "edit": F.substring("steps", F.col("step") * 2 + 1, F.lit(1)),
            "given": F.substring("steps", F.col("step") * 2 + 2, F.lit(1)),
        }
    )
    names = F.create_map(*[F.lit(x) for pair in GIVEN.items() for x in pair])
    return each.where("edit <> 'D'").select(
        "conv_id",
        F.struct(F.col("_part").alias("part"), F.col("_row").alias("row")).alias("place"),
        "step",
        "edit",
        F.when(F.col("edit") == "K", F.col("role")).otherwise(names[F.col("given")]).alias("role"),
        F.when(F.col("edit") == "I", F.lit("")).otherwise(F.col("text")).alias("text"),
    )


def checksums(turns: DataFrame) -> DataFrame:
    """``conv_id, sha256`` of the repaired turns ``role:text``, a line break between them.

    A hash runs from end to end, so a conversation passes through one task, turn by turn; no more than
    a batch of it is held.
    """
    kind = dict(turns.dtypes)["conv_id"]
    lines = turns.select("conv_id", "place", "step", F.concat("role", F.lit(":"), "text").alias("line"))
    dealt = lines.repartition("conv_id").sortWithinPartitions("conv_id", "place", "step")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, total = None, None
        for batch in batches:
            out = []
            ids = batch.column("conv_id").to_pylist()
            for conv, line in zip(ids, batch.column("line"), strict=True):
                if total is not None and conv == current:
                    total.update(b"\n")
                else:
                    if total is not None:
                        out.append((current, total.hexdigest()))
                    current, total = conv, hashlib.sha256()
                total.update(line.as_buffer())
            if out:
                yield _rows(out, schema)
        if total is not None:
            yield _rows([(current, total.hexdigest())], schema)

    spelled = f"conv_id {kind}, sha256 string"
    schema = _arrow_schema(turns, spelled)
    return arrow(dealt.select("conv_id", "line"), run, spelled)


def _arrow_schema(frame: DataFrame, spelled: str) -> pa.Schema:
    return to_arrow_schema(frame.sparkSession.createDataFrame([], spelled).schema)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )
