"""N-gram Jaccard join: documents whose sets of five-word runs overlap by 75 % of their union.

Sets are ordered globally: rare runs first, by the count of a run's bucket over all documents, then by
hash. Two sets that link share a run among the first ``n - ceil(0.75 n) + 1`` of either, so candidates
meet there. Equal sets are one set from the start.

1. A run counts for a set where a partner of fitting size could still share all it needs from there on.
   Runs that the same sets hold are one run from then on, with each set's first place among them. Of the
   sets that hold it, neighbours by size are candidates. A set's mark has the parity of its runs in each of
   ``MARK`` cells; marks differ in no more cells than sets differ in runs, so pairs whose marks differ
   more than linked sets can are left out. Marks say little of sets of many runs, which have a wide mark
   besides; it is looked at for the pairs that are left, before their sets are fetched. Candidates are
   compared by a
   trie: a set's partners are stored in it in global order, the set traverses it, partners that begin
   alike share the overlap counted so far, and a subtree is left as soon as what remains cannot reach
   the overlap that is needed. Links make components; a group of near copies is one component after
   this, without all its pairs.
2. While runs that join different components would still give many more pairs than there are rows,
   sets are put in a random order of each round, and each component is compared with the ones next to
   its sets that it meets most. In a group of near copies most pairs link, so a round leaves a fraction
   of its components; the rounds end when they no longer help.
3. Runs that then join different components give the pairs across them, as far as places, sizes and
   marks allow a link, which are compared in the same way. What shares a component already needs no
   comparison, so every link is found or implied.

Pairs carry ids and sizes; the sets themselves are fetched once, for candidates only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from burdenlens.llm.common import arrow, blocks_of, kept, pieces, summed, utf8
from burdenlens.llm.shingles import mixed, runs

PERCENT = 75
#: Buckets of the counts that order the runs, and bits of the filter of wanted sets.
BITS, FILTER_BITS = 20, 1 << 23
BUCKETS = 1 << BITS
#: Partners a trie holds at a time.
TRIE = 256
#: Bits of the mark of a set, and of the wide mark that sets of ``LARGE`` runs have beside it.
MARK, WIDE, LARGE = 1 << 10, 1 << 13, 1 << 10
#: Edges of components for each task, and the least number of tasks of more than one.
EDGES, TASKS = 1 << 17, 8
#: Pairs across components for each of their rows up to which all are formed at once (inside a join that
#: leaves out most by their marks), the share of pairs
#: of components that a round may leave for another to follow, and what each component meets in a round and
#: is compared with.
PAIRS, HELPED, MEETS, COMPARED = 32, 0.9, 6, 2


def needed(a: int, b: int, percent: int = PERCENT) -> int:
    """Least overlap of sets of these sizes: 100 * overlap >= percent * (a + b - overlap)."""
    return -(-percent * (a + b) // (100 + percent))


def _sets(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return runs(*utf8(piece.column("text")))


def _names(flat: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each set, of its runs in any order and their number; 0 for empty ones."""
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(mixed(flat + np.uint64(0x632BE59BD9B4E019)), out=sums[1:])
    size = np.diff(first)
    names = mixed((sums[first[1:]] - sums[first[:-1]]) + size.astype(np.uint64))
    return np.where(size > 0, names.view(np.int64), 0)


def _marks(flat: np.ndarray, first: np.ndarray, cells: int = MARK) -> pa.Array:
    """For each set the parity of the number of its runs in each of ``cells``, as bits."""
    words, some = [np.zeros(0, np.int64)], (1 << 20) // cells
    for start in range(0, len(first) - 1, some):
        bounds = first[start : start + some + 1]
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        cell = (flat[bounds[0] : bounds[-1]] & np.uint64(cells - 1)).astype(np.int64)
        odd = np.bincount(text * cells + cell, minlength=(len(bounds) - 1) * cells) & 1
        words.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
    bounds = pa.array(np.arange(len(first)) * (cells // 64), pa.int32())
    return pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(words)))


def _wide_marks(flat: np.ndarray, first: np.ndarray) -> pa.Array:
    """The marks of ``WIDE`` cells of the large sets, null for the others."""
    size = np.diff(first)
    large = size >= LARGE
    bounds = np.append(0, np.cumsum(size[large]))
    place = np.where(large, np.cumsum(large) - 1, 0)
    wide = _marks(flat[np.repeat(large, size)], bounds, WIDE)
    return wide.take(pa.array(place, pa.int64(), mask=~large))


# ---------------------------------------------------------------- scans


def _described(documents: DataFrame) -> DataFrame:
    """One row for each text (doc_id, n, name, mark, wide) and, for each task, its counts of runs by
    bucket."""
    kind = dict(documents.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        names = ["doc_id", "n", "name", "mark", "wide", "block", "counts"]
        key = pa.int64()
        for piece in pieces(batches, "text"):
            flat, first = _sets(piece)
            np.add.at(counts, _bucket(flat).astype(np.intp), 1)
            rows, key = piece.num_rows, piece.column("doc_id").type
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"),
                    pa.array(np.diff(first), pa.int32()),
                    pa.array(_names(flat, first), pa.int64()),
                    _marks(flat, first),
                    _wide_marks(flat, first),
                    pa.nulls(rows, pa.int32()),
                    pa.nulls(rows, pa.binary()),
                ],
                names,
            )
        if counts.any():
            blocks = blocks_of(counts)
            rows = blocks.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(rows, key),
                    pa.nulls(rows, pa.int32()),
                    pa.nulls(rows, pa.int64()),
                    pa.nulls(rows, pa.list_(pa.int64())),
                    pa.nulls(rows, pa.list_(pa.int64())),
                    *blocks.columns,
                ],
                names,
            )

    schema = f"doc_id {kind}, n int, name long, mark array<long>, wide array<long>, block int, counts binary"
    return arrow(documents.select("doc_id", "text"), run, schema)


def _bucket(flat: np.ndarray) -> np.ndarray:
    return flat >> np.uint64(64 - BITS)


def _levels(every: np.ndarray) -> np.ndarray:
    """How common the runs of a bucket are, in steps of equal numbers of buckets, then of a quarter of a
    doubling.

    A run in many sets stands out from the chance differences of buckets, which grow with the root of
    the corpus only.
    """
    steps = np.quantile(every, np.arange(1, 128) / 128)
    over = np.floor(4 * np.log2(np.maximum(every / max(steps[-1], 1), 1)))
    return (np.searchsorted(steps, every) + np.minimum(over, 127)).astype(np.uint8)


def _in_order(flat: np.ndarray, first: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The runs of every set, rare ones first."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return flat[np.lexsort((flat, levels[_bucket(flat)], text))]


def _heads(documents: DataFrame, levels: np.ndarray, percent: int) -> DataFrame:
    """``run, at, name``: the first runs of every set, once in a task; ``at`` is the size of the set
    (upper half) and the place of the run in it."""
    shared = documents.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for piece in pieces(batches, "text"):
            flat, first = _sets(piece)
            names, size = _names(flat, first), np.diff(first)
            fresh = np.zeros(len(size), bool)
            for k, name in enumerate(names.tolist()):
                if size[k] and name not in seen:
                    seen.add(name)
                    fresh[k] = True
            head = np.where(fresh, size - -(-size * percent // 100) + 1, 0)
            ordered = _in_order(flat, first, shared.value)
            text = np.repeat(np.arange(len(size)), head)
            place = np.arange(len(text)) - (np.cumsum(head) - head)[text]
            at = (size.astype(np.int64) << 32)[text] | place
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ordered[place + first[:-1][text]].view(np.int64), pa.int64()),
                    pa.array(at, pa.int64()),
                    pa.array(names[text], pa.int64()),
                ],
                ["run", "at", "name"],
            )

    return arrow(documents.select("text"), run, "run long, at long, name long")


def _shared(heads: DataFrame, percent: int) -> DataFrame:
    """``run, name, n, most, runs``: the first runs that sets which may link have in common.

    Linked sets have all their common runs from the first one on, so from there on each has at least as
    many as they need; ``most`` is the size up to which a partner needs no more. A run counts only
    where the next smaller or the next larger set has a fitting size. Runs of the same sets are put
    together as one, ``runs`` is their number; ``run`` is a hash of these sets (sets that fall together
    by chance only add candidates).
    """
    order = Window.partitionBy("run").orderBy("at", "name")
    once = heads.withColumn("a", F.lag("name").over(order)).where("a IS NULL OR a <> name")
    size = F.shiftright("at", 32)
    placed = once.select("run", "name", size.alias("n"), F.col("at").bitwiseAND((1 << 32) - 1).alias("place"),
        F.lag(size).over(order).alias("smaller"), F.lead(size).over(order).alias("larger"),
    ).withColumn("most", F.expr(f"({100 + percent} * (n - place)) div {percent} - n"))
    fitting = placed.where(f"100 * smaller >= {percent} * n OR larger <= most").select("run", "name", "n", "most")
    sets = Window.partitionBy("run")
    same = fitting.select(
        "name", "n", "most",
        F.bit_xor(F.xxhash64("name")).over(sets).alias("run"), F.count("*").over(sets).alias("sets"),
    )
    return same.where("sets > 1").groupBy("run", "name").agg(
        F.first("n").cast("int").alias("n"), F.max("most").alias("most"), F.count("*").alias("runs")
    )


def _fetched(documents: DataFrame, names: DataFrame, levels: np.ndarray) -> DataFrame:
    """``name, runs``: the sets of the given names, in global order, as bytes.

    A filter of fixed size keeps most other sets in their task; the join leaves the rest.
    """

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            name = batch.column("name").to_numpy().view(np.uint64)
            found[name >> np.uint64(64 - 23)] = True
        packed = np.packbits(found).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], ["bits"])

    packed = np.zeros(FILTER_BITS // 8, np.uint8)
    # one array of fixed size from each of a few tasks
    for r in arrow(names.coalesce(8), bits, "bits binary").toLocalIterator():
        packed |= np.frombuffer(r["bits"], np.uint8)
    shared = documents.sparkSession.sparkContext.broadcast((np.unpackbits(packed), levels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, levels = shared.value
        seen: set[int] = set()
        for piece in pieces(batches, "text"):
            flat, first = _sets(piece)
            names = _names(flat, first)
            take = wanted[names.view(np.uint64) >> np.uint64(64 - 23)].astype(bool)
            take &= np.diff(first) > 0
            rows = []
            for k in np.flatnonzero(take).tolist():
                if names[k] not in seen:
                    seen.add(names[k])
                    rows.append(k)
            if not rows:
                continue
            ordered = _in_order(flat, first, levels)
            sets = [ordered[first[k] : first[k + 1]].tobytes() for k in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[rows], pa.int64()), pa.array(sets, pa.binary())], ["name", "runs"]
            )

    sets = arrow(documents.select("text"), run, "name long, runs binary")
    return sets.join(names, "name", "left_semi").groupBy("name").agg(F.first("runs").alias("runs"))


# ---------------------------------------------------------------- the trie


class Trie:
    """Sets as paths of their runs in global order; a chain without a branch is one node."""

    def __init__(self, paths: list[tuple[tuple[int, ...], int]], depth: int = 0):
        first, last = paths[0][0], paths[-1][0]  # sorted, so these two differ first
        end = depth
        while end < len(first) and end < len(last) and first[end] == last[end]:
            end += 1
        self.chain, self.ends = first[depth:end], [k for p, k in paths if len(p) == end]
        self.size = [len(p) for p, _ in paths]
        self.least, self.most = min(self.size), max(self.size)
        self.depth, self.below = end, []
        rest = [x for x in paths if len(x[0]) > end]
        start = 0
        while start < len(rest):
            stop = start
            while stop < len(rest) and rest[stop][0][end] == rest[start][0][end]:
                stop += 1
            self.below.append(Trie(rest[start:stop], end))
            start = stop

    def links(self, probe: frozenset[int], percent: int, overlap: int = 0) -> Iterator[int]:
        """Numbers of the sets that link with the probe."""
        overlap += sum(map(probe.__contains__, self.chain))
        if overlap + self.most - self.depth < needed(self.least, len(probe), percent):
            return
        if overlap >= needed(self.depth, len(probe), percent):
            yield from self.ends
        for node in self.below:
            yield from node.links(probe, percent, overlap)


def linked(sets: list[bytes], probe: bytes, percent: int) -> list[int]:
    """Numbers of the sets that link with the probe, by a trie for each ``TRIE`` of them."""
    other, found = frozenset(np.frombuffer(probe, np.uint64).tolist()), []
    paths = sorted((tuple(np.frombuffer(s, np.uint64).tolist()), k) for k, s in enumerate(sets))
    for start in range(0, len(paths), TRIE):
        found.extend(Trie(paths[start : start + TRIE]).links(other, percent))
    return found


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b`` of the candidate pairs that link, by the sets that ``_fetched`` gives."""
    sets = sets.join(_ends(pairs), "name", "left_semi")
    full = pairs.join(sets.select(F.col("name").alias("a"), F.col("runs").alias("ra")), "a").join(
        sets.select(F.col("name").alias("b"), F.col("runs").alias("rb")), "b"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                groups: dict[int, list[int]] = {}
                for k, b in enumerate(batch.column("b").to_pylist()):
                    groups.setdefault(b, []).append(k)
                ra, rb = batch.column("ra").to_pylist(), batch.column("rb").to_pylist()
                rows = sorted(
                    g[k]
                    for g in groups.values()
                    for k in linked([ra[i] for i in g], rb[g[0]], percent)
                )
                yield batch.select(["a", "b"]).take(pa.array(rows, pa.int64()))

    return arrow(full.select("a", "b", "ra", "rb"), run, "a long, b long")


# ---------------------------------------------------------------- components


def _forest(tied: DataFrame) -> DataFrame:
    """``u > v`` rows: the names that the edges of a task connect, tied to the smallest of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[int, int] = {}

        def top(name: int) -> int:
            while (up := above.setdefault(name, name)) != name:
                above[name] = name = above[up]
            return name

        for batch in batches:
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
                u, v = top(u), top(v)
                above[max(u, v)] = min(u, v)
        ends = [(name, top(name)) for name in above]
        ends = [x for x in ends if x[0] != x[1]]
        for start in range(0, len(ends), 1 << 16):
            u, v = zip(*ends[start : start + (1 << 16)], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return arrow(tied, run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """``name, root``: the smallest name each name of an edge reaches.

    Each task ties up its ``EDGES``, which is all where they fit one. Of more tasks, alternating stars:
    every name's larger neighbours, then all its smaller ones, are tied to the
    smallest name next to it, until each is tied to its root. The number of rounds grows with the
    logarithm of the longest chain.
    """

    def star(tied: DataFrame, larger: bool) -> DataFrame:
        """``u > v`` rows; each name's neighbours on one side, tied to its smallest neighbour."""
        if larger:
            both = tied.union(tied.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            both = tied
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        joined = both.join(least, "u").coalesce(tasks)
        if larger:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        return out.where("u <> v").distinct().coalesce(tasks)

    def state(tied: DataFrame) -> tuple:
        return tuple(tied.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())

    tied = kept(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u <> v")
        .distinct()
    )
    now = state(tied)
    whole = now[0] <= EDGES
    tasks = 1 if whole else max(now[0] // EDGES, TASKS)  # few edges need few files
    tied = kept(_forest(tied.coalesce(tasks)))
    while not whole:
        tied = kept(star(star(tied, True), False))
        before, now = now, state(tied)
        if now == before:
            break
    ends = tied.select(F.col("u").alias("name"), F.col("v").alias("root"))
    return ends.union(tied.select("v", "v").distinct())


def _may_link(percent: int, na: str = "p.n", a: str = "p.mark", nb: str = "q.n", b: str = "q.mark") -> str:
    """SQL: whether marks differ in no more cells than linked sets of these sizes differ in runs."""
    differ = " + ".join(f"bit_count({a}[{k}] ^ {b}[{k}])" for k in range(MARK // 64))
    return f"{differ} <= {_most_apart(percent, na, nb)}"


def _most_apart(percent: int, na: str, nb: str) -> str:
    """SQL: in how many runs linked sets of these sizes may differ."""
    return f"{na} + {nb} - 2 * ceil({percent} * ({na} + {nb}) / {100 + percent})"


def _possible(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` of sets with marks that may link."""
    one, two = marks.alias("p"), marks.alias("q")
    both = pairs.join(one, F.col("a") == F.col("p.name")).join(two, F.col("b") == F.col("q.name"))
    return both.where(_may_link(percent)).select(*pairs.columns)


def _plausible(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose wide marks, where both sets are large, allow a link."""
    wide = marks.where("wide IS NOT NULL")
    for side in ("a", "b"):
        own = wide.select(F.col("name").alias(side), F.col("n").alias(f"n{side}"), F.col("wide").alias(f"w{side}"))
        pairs = pairs.join(own, side, "left")
    differ = "aggregate(zip_with(wa, wb, (x, y) -> bit_count(x ^ y)), 0, (s, c) -> s + c)"
    may = f"wa IS NULL OR wb IS NULL OR {differ} <= {_most_apart(percent, 'na', 'nb')}"
    return pairs.where(may).select("a", "b")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct()


def _across(rows: DataFrame, tied: DataFrame) -> DataFrame:
    """``run, name, n, most, runs, root`` of the runs that join different components."""
    own = rows.drop("root").join(tied, "name", "left").withColumn("root", F.coalesce("root", "name"))
    of_run = Window.partitionBy("run")
    ends = own.withColumns({"x": F.min("root").over(of_run), "y": F.max("root").over(of_run)})
    return ends.where("x <> y").drop("x", "y")


def _crossing(across: DataFrame) -> tuple[float, float, float]:
    """Pairs of rows of a run and different components, rows, and pairs of components of a run."""
    of_root = across.groupBy("run", "root").agg(F.count("*").cast("double").alias("c"))
    of_run = of_root.groupBy("run").agg(
        F.sum("c").alias("s"), F.sum(F.col("c") ** 2).alias("q"), F.count("*").cast("double").alias("k")
    )
    sums = of_run.agg(F.sum(F.expr("(s * s - q) / 2")), F.sum("s"), F.sum(F.expr("k * (k - 1) / 2")))
    return tuple(x or 0.0 for x in sums.first())


def _next_to(across: DataFrame, turn: int, marks: DataFrame, percent: int, each: int = COMPARED) -> DataFrame:
    """``a, b``: for each component a few pairs that may link with others that lie next to it.

    Each run has an order of its own in each turn, so a set meets other neighbours at every run.
    """
    meeting = Window.partitionBy("run").orderBy(F.xxhash64("name", "run", F.lit(turn)), "name")
    # runs of fewer sets give few pairs at the end
    crowded = across.withColumn("sets", F.count("*").over(Window.partitionBy("run"))).where(f"sets > {MEETS}")
    named = {"name": "a", "n": "na", "most": "ma", "root": "ra", "mark": "other"}
    before = F.array(
        *(F.struct(*(F.lag(c, k).over(meeting).alias(to) for c, to in named.items())) for k in range(1, MEETS + 1))
    )
    own = ["root", "n", "most", "runs", "mark"]
    met = (
        crowded.join(marks.select("name", "mark"), "name")
        .select(*own, F.col("name").alias("b"), before.alias("before"))
        .select(*own, "b", F.inline("before"))
        .where(f"ra <> root AND 100 * least(na, n) >= {percent} * greatest(na, n) AND na <= most AND n <= ma")
        .where(_may_link(percent, "na", "other", "n", "mark"))
        .groupBy("root", "a", "b")
        .agg(F.sum("runs").alias("met"))
    )
    most = F.row_number().over(Window.partitionBy("root").orderBy(F.desc("met"), "a", "b"))
    return met.select("a", "b", most.alias("k")).where(f"k <= {each}").select("a", "b")


def _tied_up(
    across: DataFrame, tied: DataFrame, sets: DataFrame, marks: DataFrame, percent: int
) -> tuple[DataFrame, DataFrame]:
    """``across`` and ``tied`` after as many rounds of comparing neighbours as make pairs few; ``marks``
    are those of ``sets``."""
    before, turn = float("inf"), 0
    across = kept(across)
    while True:
        pairs, rows, components_left = _crossing(across)
        if pairs <= PAIRS * rows or components_left > HELPED * before:
            return across, tied
        before, turn = components_left, turn + 1
        found = _links(kept(_next_to(across, turn, marks, percent)), sets, percent)
        tied = kept(components(tied.select(F.col("name").alias("a"), F.col("root").alias("b")).union(found)))
        across = kept(_across(across, tied))


def groups(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row, and ``name``, the hash of its set.

    Rows link when 100 times the runs they share is at least ``percent`` times the runs of both.
    Equal sets link. A text without words, empty or null, has no runs, links with nothing and is its
    own component; so does a row without a link. The component is its smallest id; null ids count only
    if there is no other. Repeated rows stay, one by one; other columns are left out.
    """
    found = kept(_described(documents))
    rows = found.where("block IS NULL").select("doc_id", "n", "name")
    levels = _levels(summed(found.where("block IS NOT NULL").select("block", "counts"), BUCKETS))
    common = kept(_shared(_heads(documents, levels, percent), percent))
    of_set = [F.first(c).alias(c) for c in ("n", "mark", "wide")]
    one_each = found.where("block IS NULL").groupBy("name").agg(*of_set)
    marks = kept(one_each.join(common.select("name"), "name", "left_semi"))
    meeting = Window.partitionBy("run").orderBy("n", "name")
    before = {c: F.lag(c).over(meeting).alias(to) for c, to in (("name", "a"), ("n", "na"), ("most", "ma"))}
    met = common.select("name", "n", "most", "runs", *before.values())
    close = _possible(
        met.where(f"100 * na >= {percent} * n AND na <= most AND n <= ma")
        .groupBy("a", F.col("name").alias("b"))
        .agg(F.sum("runs").alias("met")),
        marks,
        percent,
    )
    # a neighbour by size and one by chance, those met most, are enough to tie a group together
    near = close.groupBy("b").agg(F.max_by("a", F.struct("met", "a")).alias("a")).select("a", "b")
    chance = _next_to(common.withColumn("root", F.col("name")), 0, marks, percent, 1)
    first = kept(_plausible(near.union(chance), marks, percent))
    names = kept(_ends(first))
    sets = kept(_fetched(documents, names, levels))
    tied = kept(components(_links(first, sets, percent)))
    known = marks.join(names, "name", "left_semi")
    across, tied = _tied_up(_across(common, tied), tied, sets, known, percent)
    left = across.join(marks.select("name", "mark"), "name")
    crossing = left.alias("p").join(
        left.alias("q"),
        F.expr(
            "p.run = q.run AND p.root <> q.root AND (p.n < q.n OR (p.n = q.n AND p.name < q.name))"
            f" AND 100 * p.n >= {percent} * q.n AND q.n <= p.most AND p.n <= q.most AND {_may_link(percent)}"
        ),
    )
    pairs = crossing.select(F.col("p.name").alias("a"), F.col("q.name").alias("b")).distinct()
    hopeful = kept(_plausible(pairs, marks, percent))
    more = kept(_ends(hopeful).join(names, "name", "left_anti"))
    if more.take(1):
        sets = sets.union(kept(_fetched(documents, more, levels)))
    stars = tied.select(F.col("name").alias("a"), F.col("root").alias("b"))
    every = stars.union(_links(hopeful, sets, percent))
    roots = components(every)
    named = rows.join(roots, "name", "left").withColumn("root", F.coalesce("root", "name"))
    smallest = named.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    return (
        named.join(smallest, "root", "left")
        .select(
            "doc_id",
            F.col("n").cast("long").alias("n_shingles"),
            F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
            "name",
        )
    )
