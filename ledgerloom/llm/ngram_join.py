"""Exact Jaccard join on word n-grams with a count-vector R-tree, and its connected groups.

A document's set of shingles is a *class*; documents with equal sets share one.
Shingles are hashed into ``GROUPS`` groups and the counts of a class are a
point.  For two sets the overlap is at most the sum over the groups of the
smaller count, and for a node of the tree at most that with the node's largest
counts, so an R-tree over the points leaves few pairs to verify on the sets.

No cut of the point space into cells keeps apart what isn't linked: linked
counts may differ by a fifth of their size in all, and in any few coordinates
(size, mass of some groups) the counts of unrelated texts differ by less.  A
tree over all points would be one tree for one machine.  So the points are cut by
what linked sets must share: one of their first ``n - ceil(t n) + 1`` shingles in
any fixed global order, rare ones first (the order uses counts over all
documents in a sketch of fixed size).  Shingles whose classes have the same
smallest and largest name are one *meeting*, and trees are built over the points
of a meeting, ``CELL`` at a time.

Links are found in three steps, so that neither a star nor all pairs of a large
group are made, and no meeting is in one task as a whole.

(1) Each class goes, with its text, to a cell of one meeting, its *home*, where
the tree's pairs are verified until the linked ones are connected.

(2) Of every meeting of more than a cell whose classes are still in different
components, one class a component is put into trees again and lists the first
that may link with it; those pairs are verified, and rounds go on until one
joins nothing.  Copies of one text, however many, are one after this.

(3) Meetings still apart are dealt as pairs of blocks; the tree's pairs across
components are listed, a few for each two components at first, then more, and
verified on whole texts, until none is left that was not tried.  A meeting of
which a round listed every pair has none left, since components only grow, so
only those that the round's limit held back are dealt again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import words
from ledgerloom.llm.components import labels
from ledgerloom.llm.store import stored

U = np.uint64
GROUPS, LEAF, CELL = 512, 32, 512
SKETCH_BITS = 18
#: Pairs a round lists for each two components of a block, at first and as factor from round to round.
FIRST_PAIRS, MORE_PAIRS = 1, 16
ROWS_AT_ONCE = 100_000
#: Ids that are sent to every executor to pick rows where they lie (16 MB); more are joined by shuffling.
IDS_SENT = 2_000_000


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and where each text's begin.

    A text of fewer than ``n`` words has its whole sequence as its one shingle; without words it has none."""
    h, begin = words.hashed(column, lower=True)
    s, at = words.runs(h, begin, n)
    count = np.diff(begin)
    out = []
    for i in range(len(count)):
        if count[i] >= n:
            out.append(np.unique(s[at[i] : at[i + 1]]))
        elif count[i]:
            v = np.zeros(1, np.uint64)
            for x in h[begin[i] : begin[i + 1]]:
                v = words.mix(v + x)
            out.append(v + U(count[i]))
        else:
            out.append(np.zeros(0, np.uint64))
    ends = np.cumsum([0, *map(len, out)])
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), ends


def sets_in_slices(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``shingle_sets``, but with no more than a slice of the texts at a time besides the sets."""
    got = [shingle_sets(part.column(0), n) for part in words.text_slices([pa.record_batch([column], ["t"])], 0)]
    sizes = np.concatenate([np.diff(at) for _, at in got])
    return np.concatenate([s for s, _ in got]), np.concatenate([[0], np.cumsum(sizes)])


def group_of(s: np.ndarray) -> np.ndarray:
    return (s >> U(40)) % U(GROUPS)


def count_vectors(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many shingles of each set fall into each group."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    return np.bincount(owner * GROUPS + group_of(s).astype(np.int64), minlength=(len(at) - 1) * GROUPS).reshape(-1, GROUPS)


def needed(n: int, percent: int) -> int:
    """Least overlap that a linked set of this size has: the size times the threshold, rounded up."""
    return -(-n * percent // 100)


def bound(a, na, b, nb, percent: int):
    """Whether counts (or a node's largest counts) allow a link: 100 I >= percent (na + nb - I)."""
    return (100 + percent) * np.minimum(a, b).sum(-1, dtype=np.int64) >= percent * (na + nb)


class CountTree:
    """R-tree over count vectors, packed in order of size; nodes keep largest counts and the range of sizes."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((vectors.argmax(1), sizes))
        self.points, self.sizes = vectors[self.order].astype(np.int32), sizes[self.order].astype(np.int64)
        self.levels = []
        top, low, high = self.points, self.sizes, self.sizes
        while len(top) > LEAF:
            at = np.arange(0, len(top), LEAF)
            top, low, high = np.maximum.reduceat(top, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((top, low, high))

    def after(self, k: int, percent: int) -> np.ndarray:
        """Places behind place ``k`` of the order whose points may link with it."""
        q, n = self.points[k], self.sizes[k]
        nodes = np.arange(len(self.levels[-1][0]) if self.levels else 1)
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low, high = self.levels[depth]
            nodes = nodes[(high[nodes] >= n) & (percent * low[nodes] <= 100 * n)]
            nodes = nodes[bound(top[nodes], low[nodes], q, n, percent)]
            below = len(self.levels[depth - 1][0]) if depth else len(self.points)
            nodes = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
            nodes = nodes[nodes < below]
        if not self.levels:
            nodes = np.arange(len(self.points))
        nodes = nodes[nodes > k]
        return nodes[bound(self.points[nodes], self.sizes[nodes], q, n, percent)]


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return len(a) > 0 and len(b) > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def by_key(batches, key: int = 0):
    """Tables of the rows of one key, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        if held and held[0].column(key)[0].as_py() != k[0]:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def facts(docs: DataFrame, n: int) -> DataFrame:
    """``doc_id, n_shingles, class, check`` of every row, and one row a task with its sketch of shingle counts."""

    def run(batches):
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in words.text_slices(batches):
            s, at = shingle_sets(batch.column(1), n)
            sketch += np.bincount((s >> U(64 - SKETCH_BITS)).astype(np.int64), minlength=len(sketch))
            sizes = np.diff(at)
            total = lambda v: np.concatenate([[U(0)], np.cumsum(v, dtype=np.uint64)])[at]
            one, two = np.diff(total(words.mix(s + U(1)))), np.diff(total(words.mix(s ^ U(0x5851F42D4C957F2D))))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(sizes, pa.int64()), pa.array(words.mix(one).view(np.int64)), pa.array(two.view(np.int64)),
                pa.nulls(len(sizes), pa.binary()),
            ], ["doc_id", "n_shingles", "class", "check", "sketch"])
        yield pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * 4, pa.array([sketch.astype("<i8").tobytes()], pa.binary())], ["doc_id", "n_shingles", "class", "check", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, class long, check long, sketch binary")


def sketch_of(rows: DataFrame) -> np.ndarray:
    """How many of each sketch cell's shingles all documents hold: 2**SKETCH_BITS sums, whatever the input."""

    def cells(batches):
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_py(), "<i8")
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], ["cell", "n"])

    out = np.zeros(1 << SKETCH_BITS, np.int64)
    got = rows.where("sketch is not null").select("sketch").mapInArrow(cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out


def keys(docs: DataFrame, n: int, percent: int, sketch) -> DataFrame:
    """``key, class``: the shingles by which each class meets others."""

    def run(batches):
        counts = sketch.value
        for batch in words.text_slices(batches):
            s, at = shingle_sets(batch.column(1), n)
            sizes = np.diff(at)
            total = np.concatenate([[U(0)], np.cumsum(words.mix(s + U(1)), dtype=np.uint64)])[at]
            names = words.mix(np.diff(total))
            weight = counts[(s >> U(64 - SKETCH_BITS)).astype(np.int64)]
            chosen, lens = [], []
            for i, size in enumerate(sizes.tolist()):
                first = size - needed(size, percent) + 1 if size else 0
                lens.append(first)
                if first:
                    mine, w = s[at[i] : at[i + 1]], weight[at[i] : at[i + 1]]
                    if first < size:
                        mine = mine[np.lexsort((mine, w))[:first]]
                    chosen.append(mine)
            if chosen:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(chosen).view(np.int64)), pa.array(np.repeat(names, lens).view(np.int64))], ["key", "class"])

    return docs.mapInArrow(run, "key long, class long")


def meetings(met: DataFrame) -> DataFrame:
    """``meeting, class`` from ``key, class``: keys whose several classes have the same ends are one meeting.

    The ends of a key are combined where its rows lie; keys of one class have nothing to meet."""
    ends = met.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo < hi").select("key", F.xxhash64("lo", "hi").alias("meeting"))
    return met.join(ends, "key").select("meeting", "class").distinct()


def packed(v: np.ndarray) -> bytes:
    """A point in two bytes a group, or four where a count needs them."""
    return v.astype("<u2" if v.max(initial=0) < 1 << 16 else "<u4").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * GROUPS else "<u4").astype(np.int32)


def home_links(homes: DataFrame, n: int, percent: int) -> DataFrame:
    """``node, label, n_shingles, vector`` for the classes of a home cell: the smallest node it is connected to there, and its point."""

    def run(batches):
        for group in by_key(batches):
            nodes = group.column("node").to_numpy()
            s, at = sets_in_slices(group.column("text").combine_chunks(), n)
            vectors = count_vectors(s, at)
            tree = CountTree(vectors, np.diff(at))
            root = list(range(len(nodes)))

            def find(i):
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            get = lambda i: s[at[i] : at[i + 1]]
            for k in range(len(nodes)):
                a = int(tree.order[k])
                for b in tree.order[tree.after(k, percent)].tolist():
                    x, y = find(a), find(b)
                    if x != y and linked(get(a), get(b), percent):
                        x, y = (x, y) if nodes[x] <= nodes[y] else (y, x)
                        root[y] = x
            points = [packed(v) for v in vectors]
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[[find(i) for i in range(len(nodes))]]), pa.array(np.diff(at)), pa.array(points, pa.binary())], ["node", "label", "n_shingles", "vector"])

    return homes.repartition("cell").sortWithinPartitions("cell").select("cell", "node", "text").mapInArrow(run, "node long, label long, n_shingles long, vector binary")


def blocks(met: DataFrame) -> DataFrame:
    """Rows of meetings dealt to pairs of blocks of about ``CELL`` classes: ``pair, meeting, node, label, own, other``.

    The largest component of a meeting needs no pairs of its own: its blocks meet
    those of the other components only, which meet each other as well.  So a
    group that is nearly connected is dealt once, not once for each block."""
    parts = met.groupBy("meeting", "label").agg(F.count("*").alias("n"))
    shape = parts.groupBy("meeting").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("all"))
    small = F.col("all") <= CELL
    rest = F.when(small, 1).otherwise(F.ceil((F.col("all") - F.col("most.n")) / CELL)).cast("int")
    shape = shape.select("meeting", F.when(~small, F.col("most.label")).alias("main"), rest.alias("rest"), F.when(small, 0).otherwise(F.ceil(F.col("most.n") / CELL)).cast("int").alias("mains"))
    rows = met.join(shape, "meeting").withColumn("inner", F.coalesce(F.col("label") == F.col("main"), F.lit(False)))
    own = F.when(F.col("inner"), F.col("rest") + F.pmod(F.xxhash64("node"), "mains")).otherwise(F.pmod(F.xxhash64("node"), "rest")).cast("int")
    rows = rows.select("meeting", "node", "label", own.alias("own"), F.explode(F.sequence(F.lit(0), F.when(F.col("inner"), F.col("rest")).otherwise(F.col("rest") + F.col("mains")) - 1)).alias("other"))
    return rows.select(F.xxhash64("meeting", F.least("own", "other"), F.greatest("own", "other")).alias("pair"), "meeting", "node", "label", "own", "other")


def open_pairs(met: DataFrame, points: DataFrame, tried: DataFrame | None, percent: int, most: int | None) -> DataFrame:
    """``a, b``: pairs of a meeting across components that the trees let through and that weren't tried.

    ``most`` for each two components of two blocks; without it, the first for each class of a block.
    A ``meeting`` of which that left out a pair has a row of its own, without ``a, b``."""

    def rows_of(a, b, held_back):
        none = [None] * len(held_back)
        return pa.RecordBatch.from_arrays([pa.array(a + none, pa.int64()), pa.array(b + none, pa.int64()), pa.array([None] * len(a) + held_back, pa.int64())], ["a", "b", "meeting"])

    def run(batches):
        for group in by_key(batches):
            nodes, comp, own, other = (group.column(c).to_numpy() for c in ("node", "label", "own", "other"))
            vectors = np.stack([unpacked(x) for x in group.column("vector").to_pylist()])
            tree = CountTree(vectors, group.column("n_shingles").to_numpy())
            known = {(n, x) for n, xs in zip(nodes.tolist(), group.column("tried").to_pylist()) for x in xs or ()}
            apart = bool((own != other).any())  # two blocks: pairs inside one are listed where it meets itself
            seen, a, b, more = {}, [], [], False
            for k in range(len(nodes)):
                i = tree.order[k]
                for j in tree.order[tree.after(k, percent)]:
                    two = (min(comp[i], comp[j]), max(comp[i], comp[j]))
                    if two[0] == two[1] or (apart and own[i] == own[j]):
                        continue
                    low, high = min(nodes[i], nodes[j]), max(nodes[i], nodes[j])
                    if (low, high) in known:
                        continue
                    if seen.get(two, 0) >= (most or 1):
                        more = True
                        continue
                    seen[two] = seen.get(two, 0) + 1
                    a.append(low), b.append(high)
                    if most is None:
                        more = True
                        break
                if len(a) > ROWS_AT_ONCE:
                    yield rows_of(a, b, [])
                    a, b = [], []
            if a or more:
                yield rows_of(a, b, group.column("meeting").unique().to_pylist() if more else [])

    rows = blocks(met).join(only(points, met), "node")
    if tried is not None:
        rows = rows.join(tried.groupBy(F.col("a").alias("node")).agg(F.collect_list("b").alias("tried")), "node", "left")
    else:
        rows = rows.withColumn("tried", F.lit(None).cast("array<long>"))
    rows = rows.repartition("pair").sortWithinPartitions("pair")
    return rows.select("pair", "meeting", "node", "label", "own", "other", "n_shingles", "vector", "tried").mapInArrow(run, "a long, b long, meeting long").distinct()


def only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of these nodes; where the ids are few enough, found without moving the others."""
    ids = stored(ids.select("node").distinct(), "ngram_ids")
    return rows.join(F.broadcast(ids) if ids.count() <= IDS_SENT else ids, "node", "left_semi")


def verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs whose whole texts link."""

    def run(batches):
        for batch in batches:
            for part in words.text_slices([batch], 2):
                s, p = shingle_sets(part.column(2), n)
                t, q = sets_in_slices(part.column(3), n)
                keep = pa.array([linked(s[p[i] : p[i + 1]], t[q[i] : q[i + 1]], percent) for i in range(part.num_rows)], pa.bool_())
                yield part.select([0, 1]).filter(keep)

    texts = only(texts, pairs.select(F.explode(F.array("a", "b")).alias("node")))
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("s"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("t"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "s", "t").mapInArrow(run, "a long, b long")


def in_cells(meeting: str, size: str, by: str):
    """The cell of a meeting that a row goes to; cells have about ``CELL`` rows."""
    return F.xxhash64(meeting, F.pmod(F.xxhash64(by), F.ceil(F.col(size) / CELL)))


def still_apart(met: DataFrame, label: DataFrame) -> DataFrame:
    """``meeting, node, label`` of the meetings whose classes are in several components."""
    placed = met.join(label, "node")
    apart = placed.groupBy("meeting").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("meeting")
    return placed.join(apart, "meeting", "left_semi").select("meeting", "node", "label")


def joined_by(label: DataFrame, links: DataFrame) -> tuple[DataFrame, bool]:
    """Components after linking nodes ``a, b``, and whether any were joined."""
    la, lb = label.select(F.col("node").alias("a"), F.col("label").alias("x")), label.select(F.col("node").alias("b"), F.col("label").alias("y"))
    edges = stored(links.join(la, "a").join(lb, "b").where("x <> y").select("x", "y").distinct(), "ngram_edges")
    if edges.isEmpty():
        return label, False
    merged = labels(edges, "x", "y", "label", "to")
    return stored(label.join(merged, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "ngram_labels"), True


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Connected groups of documents under ``100 |A & B| >= percent |A | B|``.

    Returns one row per input row: ``doc_id, n_shingles, class, component_id``,
    where ``component_id`` is the smallest id that links lead to, its own
    included.  Texts without words, null ones too, link with nothing; a text of
    any length is worked on whole.  Ids are whole numbers; rows of one id count as one document for links; a null id
    is reached by nothing but an equal set.  Any table size, empty included,
    and further columns of any name will do.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = stored(facts(docs, n), "ngram_facts")
    sketch = spark.sparkContext.broadcast(sketch_of(rows))
    rows = rows.where("sketch is null").drop("sketch")
    classes = rows.where("n_shingles > 0").groupBy("class", "check", "n_shingles").agg(F.min("doc_id").alias("node"))
    classes = stored(classes.where("node is not null"), "ngram_classes")
    met = meetings(keys(docs, n, percent, sketch))
    met = stored(met.join(classes.select("class", "node"), "class").select("meeting", "node").distinct(), "ngram_meetings")
    sizes = met.groupBy("meeting").agg(F.count("*").alias("size"))
    home = met.join(sizes, "meeting").groupBy("node").agg(F.max(F.struct("size", "meeting")).alias("h"))
    home = home.select("node", in_cells("h.meeting", "h.size", "node").alias("cell"))
    texts = stored(docs.join(home, docs.doc_id == home.node).select("cell", "node", "text"), "ngram_texts")
    points = stored(home_links(texts, n, percent), "ngram_home")
    label = points.groupBy("node").agg(F.min("label").alias("label"))
    points, texts = points.drop("label"), texts.select("node", "text")
    tried = None
    large = stored(sizes.where(F.col("size") > CELL).select("meeting"), "ngram_large")
    while not large.isEmpty():  # (2)
        some = still_apart(met.join(large, "meeting", "left_semi"), label).groupBy("meeting", "label").agg(F.min("node").alias("node"))
        pairs = stored(open_pairs(stored(some, "ngram_some"), points, tried, percent, None), "ngram_pairs").where("a is not null").select("a", "b")
        label, joined = joined_by(label, stored(verified(pairs, texts, n, percent), "ngram_links"))
        tried = pairs if tried is None else tried.unionByName(pairs)
        if not joined:
            break
    most = FIRST_PAIRS
    while True:  # (3)
        apart = stored(still_apart(met, label), "ngram_apart")
        found = stored(open_pairs(apart, points, tried, percent, most), "ngram_pairs")
        pairs, more = found.where("a is not null").select("a", "b"), found.where("a is null").select("meeting").distinct()
        if pairs.isEmpty():
            break
        label, _ = joined_by(label, stored(verified(pairs, texts, n, percent), "ngram_links"))
        if more.isEmpty():
            break
        met = apart.join(more, "meeting", "left_semi").select("meeting", "node")
        tried, most = pairs if tried is None else tried.unionByName(pairs), most * MORE_PAIRS
    nodes = classes.join(label, "node", "left").select("class", "check", "n_shingles", F.coalesce("label", "node").alias("label"))
    out = rows.join(nodes, ["class", "check", "n_shingles"], "left")
    return out.select("doc_id", "n_shingles", "class", F.coalesce("label", "doc_id").alias("component_id"))
