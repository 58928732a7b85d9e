"""Chat formatting in budgeted windows.

The tokens of a conversation's turns are summed up in order; the sums choose windows that begin and
end at turns. Each window holds the conversation's system turn, some turns of history and the turns it
is made for; only assistant texts among the latter are under the loss mask, so a turn repeated as
history is masked out. The sums are taken over ranges of (conversation, turn), and a conversation is
dealt out in stretches of a fixed number of tokens, so a conversation with a large share of all rows
is formatted by many tasks. Windows of different stretches differ only in where they begin.

Template: ``<|im_start|>role``, a line break, the text, ``<|im_end|>`` and a line break for each turn.
Inside roles and texts ``&`` becomes ``&amp;`` and ``<|`` becomes ``&lt;|``, which can be undone; a
line break in a role becomes ``&#10;``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burdenlens.llm.common import arrow, running_sum

START, END = "<|im_start|>", "<|im_end|>"
SYSTEM, TARGET = "system", "assistant"

#: A window's budget, what of it history may take, and the tokens of a stretch.
BUDGET, HISTORY, STRETCH = 2048, 512, 32 * 2048


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: str) -> str:
    return text.replace("&lt;|", "<|").replace("&amp;", "&")


def _turns(conversations: DataFrame) -> DataFrame:
    """Turns with their formatted text and size in tokens (words and the template's own four)."""
    role = F.coalesce(F.col("role"), F.lit(""))
    text = F.coalesce(F.col("text"), F.lit(""))
    clean = F.replace(escaped(role), F.lit("\n"), F.lit("&#10;"))
    words = F.size(F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), ""))
    return conversations.select(
        "conv_id",
        "turn",
        role.alias("role"),
        F.concat(
            F.lit(START), clean, F.lit("\n"), escaped(text), F.lit(END), F.lit("\n")
        ).alias("block"),
        (words + 4).cast("long").alias("tokens"),
    )


def windows(
    conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, stretch: int = STRETCH
) -> DataFrame:
    """``conv_id, part, window, text, mask, repeated, tokens``: windows, in order by part and window.

    ``repeated`` is the code points at the front that repeat the system turn and history. ``mask`` lists the spans (code points, end exclusive) of the assistant texts the window is made
    for. Each turn is a target of one window. A window holds as many turns as the budget allows, at
    least one; the system turn (the first turn, if its role is system) and history come before them,
    both only as far as they leave room for the next target. A turn larger than the budget stands
    alone and whole.

    Turns go by turn number, then role and text, so ties and repeated rows each keep their place. A
    null text or role is empty; a null conversation or turn counts as the smallest. Other columns are
    left out. No rows give no windows.
    """
    turns = _turns(conversations)
    order = ("conv_id", "turn", "role", "block")
    sums = running_sum(turns, "tokens", "_end", *order)
    first = sums.groupBy("conv_id").agg(
        F.min(F.struct("_number", "role", "block", "tokens")).alias("_first"),
        F.min(F.col("_end") - F.col("tokens")).alias("_zero"),
    )
    first = first.select(
        F.col("conv_id").alias("_conv"),
        "_zero",
        F.when(F.col("_first.role") == SYSTEM, F.col("_first")).alias("_system"),
    )
    placed = sums.join(first, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    end = F.col("_end") - F.col("_zero")
    begin = end - F.col("tokens")
    part = F.floor(begin / stretch)
    placed = placed.withColumn("_from", begin).withColumn("_part_of", part)
    # the turns that end in the last tokens of a stretch are the history of the next one as well
    room = history
    last = F.col("_part_of") + 1
    again = (end <= last * stretch) & (end > last * stretch - room)
    copies = F.when(again, F.array(part, last)).otherwise(F.array(part))
    dealt = placed.select(
        "conv_id",
        "_number",
        "role",
        "block",
        "tokens",
        F.col("_system.block").alias("system"),
        F.coalesce(F.col("_system.tokens"), F.lit(0)).alias("system_tokens"),
        (F.col("_number") == F.col("_system._number")).alias("is_system"),
        F.col("_part_of"),
        F.explode(copies).alias("part"),
    ).withColumn("given", F.col("part") > F.col("_part_of"))
    keys = ["conv_id", "part"]
    sorted_ = dealt.repartition(*keys).sortWithinPartitions(*keys, "_number").drop("_part_of")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, key = _Stretch(budget, history), None
        for batch in batches:
            key = batch.schema.field("conv_id").type
            for start in range(0, batch.num_rows, 256):
                rows = batch.slice(start, 256).to_pylist()
                yield _batch([w for row in rows for w in state.take(row)], key)
        if key is not None:
            yield _batch(state.flush(), key)

    return arrow(
        sorted_,
        run,
        f"conv_id {dict(conversations.dtypes)['conv_id']}, part long, window int, text string,"
        " mask array<struct<start: int, end: int>>, repeated long, tokens long",
    )


_MASK = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _batch(rows: list[dict], key: pa.DataType) -> pa.RecordBatch:
    kinds = [key, pa.int64(), pa.int32(), pa.string(), _MASK, pa.int64(), pa.int64()]
    names = ["conv_id", "part", "window", "text", "mask", "repeated", "tokens"]
    columns = [pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names)


class _Stretch:
    """Turns of one stretch after another, in order; holds one window at most."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.key: tuple | None = None
        self.past: list[dict] = []
        self.targets: list[dict] = []

    def take(self, row: dict) -> list[dict]:
        out = []
        if (row["conv_id"], row["part"]) != self.key:
            out = self.flush()
            self.key, self.window, self.past = (row["conv_id"], row["part"]), 0, []
        if row["given"]:
            self.past.append(row)
            return out
        if self.targets and self.size + row["tokens"] > self.budget:
            self.past += self.targets
            out += self.flush()
        if not self.targets:
            self._open(row)
        self.targets.append(row)
        self.size += row["tokens"]
        return out

    def _open(self, row: dict) -> None:
        """The system turn, and history as far as these and the first target leave room for it."""
        room = self.budget - row["tokens"]
        self.before: list[str] = []
        if row["system"] is not None and not row["is_system"]:
            self.before.append(row["system"])
            room -= row["system_tokens"]
        limit = min(self.history, max(room, 0))
        kept: list[dict] = []
        for turn in reversed(self.past):
            if turn["is_system"] or turn["tokens"] > limit:
                break
            limit -= turn["tokens"]
            room -= turn["tokens"]
            kept.insert(0, turn)
        self.past = kept
        self.before += [t["block"] for t in kept]
        self.size = self.budget - row["tokens"] - room

    def flush(self) -> list[dict]:
        if not self.targets:
            return []
        repeated = at = sum(map(len, self.before))
        mask = []
        for turn in self.targets:
            block = turn["block"]
            if turn["role"] == TARGET:
                head = block.index("\n") + 1
                mask.append({"start": at + head, "end": at + len(block) - len(END) - 1})
            at += len(block)
        row = {
            "conv_id": self.key[0],
            "part": self.key[1],
            "window": self.window,
            "text": "".join([*self.before, *(t["block"] for t in self.targets)]),
            "mask": mask,
            "repeated": repeated,
            "tokens": self.size,
        }
        self.window += 1
        self.targets = []
        return [row]


def read_back(text: str) -> list[tuple[str, str]]:
    """Role and text of every turn of a formatted window."""
    turns, at = [], 0
    while at < len(text):
        head = text.index("\n", at)
        tail = text.index(END, head)
        role = unescape(text[at + len(START) : head].replace("&#10;", "\n"))
        turns.append((role, unescape(text[head + 1 : tail])))
        at = tail + len(END) + 1
    return turns


def read_back_sums(formatted: DataFrame) -> DataFrame:
    """Per conversation, what its windows say when read back: turns, their hash, the masked text.

    A hash runs over a conversation from end to end, so its windows pass through one task, one
    after another; nothing but the running hash is held.
    """
    keys = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part", "window")
    names = [
        "conv_id",
        "n_turns",
        "turns_sha256",
        "loss_chars",
        "loss_sha256",
        "formatted_chars",
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, kind = None, None

        def done(c):
            values = [c[0], c[1], c[2].hexdigest(), c[3], c[4].hexdigest(), c[5]]
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = [pa.array([v], k) for v, k in zip(values, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for start in range(0, batch.num_rows, 256):
                for row in batch.slice(start, 256).to_pylist():
                    if current is None or current[0] != row["conv_id"]:
                        if current is not None:
                            yield done(current)
                        current = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    text = row["text"]
                    for role, said in read_back(text[row["repeated"] :]):
                        current[1] += 1
                        current[2].update(f"{role}\n{said}\n".encode())
                    for span in row["mask"]:
                        said = unescape(text[span["start"] : span["end"]])
                        current[3] += len(said)
                        current[4].update(said.encode())
                    current[5] += len(text)
        if current is not None:
            yield done(current)

    schema = (
        f"conv_id {dict(formatted.dtypes)['conv_id']}, n_turns long, turns_sha256 string,"
        " loss_chars long, loss_sha256 string, formatted_chars long"
    )
    return arrow(keys, run, schema)
