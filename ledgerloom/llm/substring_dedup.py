"""Removal of word passages that an earlier document already holds.

A *sparse* suffix tree: of all suffixes of a text, those are kept that start at
an anchor.  The anchor of a window of ``WINDOW`` words is the place of its
smallest ``PREFIXES[0]``-word run, so equal windows have the same, and every
repeat of a window's length holds one.  The anchors' suffixes are split into
groups by their prefix, and each group gets a tree of its own.

*Prefixes of varying length.*  A group is named by the first 12 words of its
anchors' suffixes.  Prefixes that one document only holds have no partner and
are dropped before any text moves.  A group of more than ``GROUP_WORDS`` words
would make too large a tree: its prefix is lengthened to 24 words (or to the end
of the window, if that comes first), and where this is still too large, to all
that the window has, to both sides of the anchor.  Such a group is one leaf
repeated, of which only the smallest document counts; that is combined where
the rows lie, so a passage that a third of all documents share is in no task
as a whole.

*Stretches.*  Neighbouring windows mostly share their anchor, so they travel as
one stretch of text instead of ``WINDOW`` words each.

*Subtrees.*  A task packs the groups of many prefixes until ``TREE_BYTES`` of text,
sorts the suffixes of their stretches by doubling prefix names and takes the
common prefix of each with the next.  A run of neighbours that share a window
at least is an internal node as deep as that: all suffixes below it repeat each
other, and those of any but the smallest document are removed.  Windows that
overlap are merged, so what is reported are maximal passages.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import words
from ledgerloom.llm.ngram_join import by_key
from ledgerloom.llm.store import stored

WINDOW, PREFIXES = 50, (12, 24)
GROUP_WORDS, TREE_BYTES = 1 << 16, 4 << 20
#: Parts that the rows of one repeated window are dealt to when its smallest document is brought back to them.
SALTS = 16
U = np.uint64


def window_starts(begin: np.ndarray, window: int) -> np.ndarray:
    """Places in joined texts at which a window inside one text starts."""
    total = int(begin[-1])
    return np.flatnonzero(np.repeat(begin[1:], np.diff(begin)) - np.arange(total) >= window)


def anchor_keys(h: np.ndarray, starts: np.ndarray, window: int, prefix: int) -> np.ndarray:
    """The smallest run of ``prefix`` words in each window: the prefix of its anchor's suffix."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    g, _ = words.runs(h, np.array([0, len(h)]), prefix)
    span, have = window - prefix + 1, 1
    while 2 * have <= span:
        g, have = np.minimum(g[:-have], g[have:]), 2 * have
    if have < span:
        g = np.minimum(g[: len(g) - (span - have)], g[span - have :])
    return g[starts]


def anchors(h: np.ndarray, starts: np.ndarray, window: int, prefix: int) -> np.ndarray:
    """The place of that run, the first one if it occurs twice."""
    g, _ = words.runs(h, np.array([0, len(h)]), prefix)
    best, span, have = np.arange(len(g)), window - prefix + 1, 1
    first = lambda a, b: np.where(g[b] < g[a], b, a)
    while 2 * have <= span:
        best, have = first(best[:-have], best[have:]), 2 * have
    if have < span:
        best = first(best[: len(best) - (span - have)], best[span - have :])
    return best[starts]


def longer_keys(h: np.ndarray, starts: np.ndarray, window: int, prefix: int, longer: int) -> np.ndarray:
    """The prefix of ``longer`` words of each anchor's suffix, or as many as the window has; two runs of ``prefix`` words cover it."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    g, _ = words.runs(h, np.array([0, len(h)]), prefix)
    at = anchors(h, starts, window, prefix)
    size = np.minimum(starts + window - at, longer)
    return words.mix(words.mix(g[at]) + g[at + size - prefix] + size.astype(np.uint64))


def stretches(starts: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of runs of neighbouring windows with one key, and where they end."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero((keys[1:] != keys[:-1]) | (starts[1:] != starts[:-1] + 1)) + 1
    return np.concatenate([[0], cut]), np.concatenate([cut, [len(starts)]])


def deep_nodes(h: np.ndarray, begin: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes of joined texts that hold a window, in order; the words each shares with the one before it; the deep node above each.

    Names of prefixes of 1, 2, 4 ... words are dense and rise with the prefix,
    a text's end counting as the smallest word, so the last are the order, and
    the shared words are found by going down the names again."""
    total = len(h)
    room = np.repeat(begin[1:], np.diff(begin)) - np.arange(total)
    at = np.flatnonzero(room >= window)
    if not len(at):
        return at, at, at
    names, depth = [np.unique(h, return_inverse=True)[1].astype(np.int64)], 1
    while depth < window:
        ahead = np.minimum(np.arange(total) + depth, total - 1)
        tail = np.where(room > depth, names[-1][ahead] + 1, 0)
        names.append(np.unique(names[-1] * (total + 1) + tail, return_inverse=True)[1].astype(np.int64))
        depth *= 2
    order = at[np.argsort(names[-1][at], kind="stable")]
    a, b = order[:-1], order[1:]
    least = np.minimum(room[a], room[b])
    shared = np.zeros(len(a), np.int64)
    for k in range(len(names) - 1, -1, -1):
        x, y = np.minimum(a + shared, total - 1), np.minimum(b + shared, total - 1)
        same = (shared + (1 << k) <= least) & (names[k][x] == names[k][y])
        shared[same] += 1 << k
    shared = np.concatenate([[0], shared])
    return order, shared, np.cumsum(shared < window) - 1


def merged(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Word ranges that windows at these starts cover."""
    if not len(starts):
        return []
    starts = np.unique(starts)
    cut = np.flatnonzero(starts[1:] > starts[:-1] + window) + 1
    return list(zip(starts[np.concatenate([[0], cut])].tolist(), (starts[np.concatenate([cut - 1, [len(starts) - 1]])] + window).tolist(), strict=True))


def window_names(h: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit names of whole windows."""
    a, _ = words.runs(h, np.array([0, len(h)]), window)
    b, _ = words.runs(words.mix(h ^ U(0x2545F4914F6CDD1D)), np.array([0, len(h)]), window)
    return a[starts].view(np.int64), b[starts].view(np.int64)


def chosen(owner: np.ndarray, keys: np.ndarray, lists: list) -> np.ndarray:
    """Which windows have a key that their text's list holds."""
    keep = np.zeros(len(keys), bool)
    edges = np.searchsorted(owner, np.arange(len(lists) + 1))
    for i, ks in enumerate(lists):
        if ks and edges[i] < edges[i + 1]:
            keep[edges[i] : edges[i + 1]] = np.isin(keys[edges[i] : edges[i + 1]], np.array(ks, np.int64).view(np.uint64))
    return keep


def windows_of(column: pa.Array, window: int, prefixes: tuple[int, int], long: list | None):
    """Word hashes, where texts begin, and the windows' starts, texts and keys; with ``long``, those of its prefixes only, under their longer keys."""
    h, begin = words.hashed(column)
    starts = window_starts(begin, window)
    keys, owner = anchor_keys(h, starts, window, prefixes[0]), np.searchsorted(begin, starts, "right") - 1
    if long is not None:
        keep = chosen(owner, keys, long)
        starts, owner = starts[keep], owner[keep]
        keys = longer_keys(h, starts, window, *prefixes)
    return h, begin, starts, owner, keys


def key_rows(docs: DataFrame, window: int, prefixes: tuple[int, int], name: str) -> DataFrame:
    """``key, doc_id, n``: the prefix of each stretch and its number of words; of the ``long`` ones of a text if there is such a column."""
    lengthened = "long" in docs.columns

    def run(batches):
        for batch in words.text_slices(batches):
            _, _, starts, owner, keys = windows_of(batch.column(1), window, prefixes, batch.column(2).to_pylist() if lengthened else None)
            first, end = stretches(starts, keys)
            yield pa.RecordBatch.from_arrays([pa.array(keys[first].view(np.int64)), batch.column(0).take(pa.array(owner[first])), pa.array(end - first + window - 1, pa.int64())], ["key", "doc_id", "n"])

    return stored(docs.select("doc_id", "text", *(["long"] if lengthened else [])).mapInArrow(run, "key long, doc_id long, n long"), name)


def lists_of(rows: DataFrame, group_words: int) -> DataFrame:
    """``doc_id, short, long``: the prefixes of each document that others hold too, by whether their group is small enough for a tree."""
    groups = rows.groupBy("key").agg(F.sum("n").alias("size"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("key", (F.col("size") > group_words).alias("long"))
    held = rows.select("key", "doc_id").distinct().join(groups, "key")
    return held.groupBy("doc_id").agg(F.collect_list(F.when(~F.col("long"), F.col("key"))).alias("short"), F.collect_list(F.when(F.col("long"), F.col("key"))).alias("long"))


def stretch_rows(held: DataFrame, window: int, prefixes: tuple[int, int]) -> DataFrame:
    """``key, doc_id, rid, start, text``: the stretches of the ``short`` prefixes of each text; of longer ones where there is a column ``before``."""
    lengthened = "before" in held.columns

    def run(batches):
        for batch in words.text_slices(batches, 2):
            column = batch.column(2)
            _, begin, starts, owner, keys = windows_of(column, window, prefixes, batch.column(4).to_pylist() if lengthened else None)
            keep = chosen(owner, keys, batch.column(3).to_pylist())
            starts, keys, owner = starts[keep], keys[keep], owner[keep]
            a, b = stretches(starts, keys)
            data, at, ends, _ = words.parsed(column)
            raw = data.tobytes()
            pieces = [raw[x:y] for x, y in zip(at[starts[a]].tolist(), ends[starts[b - 1] + window - 1].tolist(), strict=True)]
            who = pa.array(owner[a])
            yield pa.RecordBatch.from_arrays([pa.array(keys[a].view(np.int64)), batch.column(0).take(who), batch.column(1).take(who), pa.array(starts[a] - begin[owner[a]]), pa.array(pieces, pa.binary()).cast(pa.string())],
                                             ["key", "doc_id", "rid", "start", "text"])

    return held.where("size(short) > 0").select("doc_id", "rid", "text", "short", *(["before"] if lengthened else [])).mapInArrow(run, "key long, doc_id long, rid long, start long, text string")


def tree_ranges(rows: DataFrame, window: int) -> DataFrame:
    """``doc_id, rid, lo, hi``: word ranges to remove, found by the subtrees of all prefix groups."""

    def solve(groups: list[pa.Table]):
        t = pa.concat_tables(groups).combine_chunks()
        h, begin = words.hashed(t.column("text").combine_chunks() if t.num_rows else pa.array([], pa.string()))
        order, _, node = deep_nodes(h, begin, window)
        if not len(order):
            return
        owner = np.searchsorted(begin, order, "right") - 1
        ids = t.column("doc_id").to_numpy()
        least = np.minimum.reduceat(ids[owner], np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])))
        gone = least[node] < ids[owner]
        at = np.sort(order[gone])
        owner = np.searchsorted(begin, at, "right") - 1
        cut = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1, [len(owner)]])
        rids, base = t.column("rid").to_numpy(), t.column("start").to_numpy()
        out = []
        for x, y in zip(cut[:-1], cut[1:]):
            if y > x:
                k = owner[x]
                out += [(ids[k], rids[k], base[k] + lo, base[k] + hi) for lo, hi in merged(at[x:y] - begin[k], window)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["doc_id", "rid", "lo", "hi"])

    def run(batches):
        groups, size = [], 0
        for group in by_key(batches):
            if group.num_rows > 1:
                groups.append(group)
                size += group.column("text").nbytes
                if size > TREE_BYTES:
                    yield from solve(groups)
                    groups, size = [], 0
        if groups:
            yield from solve(groups)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "doc_id long, rid long, lo long, hi long")


def whole_window_ranges(held: DataFrame, window: int, prefixes: tuple[int, int]) -> DataFrame:
    """The same for prefixes lengthened to the whole window: one leaf each, reduced to its smallest document.

    ``held`` has the long prefixes of both lengths, ``before`` and ``long``."""

    def run(batches):
        for batch in words.text_slices(batches, 2):
            h, begin, starts, owner, keys = windows_of(batch.column(2), window, prefixes, batch.column(3).to_pylist())
            keep = chosen(owner, keys, batch.column(4).to_pylist())
            starts, owner = starts[keep], owner[keep]
            if len(starts):
                a, b = window_names(h, starts, window)
                who = pa.array(owner)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), batch.column(0).take(who), batch.column(1).take(who), pa.array(starts - begin[owner])], ["a", "b", "doc_id", "rid", "start"])

    rows = stored(held.where("size(long) > 0").select("doc_id", "rid", "text", "before", "long").mapInArrow(run, "a long, b long, doc_id long, rid long, start long"), "substring_windows")
    least = rows.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(SALTS)).cast("int"))
    return dealt.join(least, ["a", "b", "salt"]).where("first < doc_id").select("doc_id", "rid", F.col("start").alias("lo"), (F.col("start") + window).alias("hi"))


def repeated_passages(held: DataFrame, window: int, prefixes: tuple[int, int], group_words: int) -> DataFrame:
    """``doc_id, rid, lo, hi``: word ranges of texts whose windows start in a smaller document too; they may overlap.

    ``held`` has the texts that share a prefix, with their ``short`` and ``long`` ones."""
    out = tree_ranges(stretch_rows(held, window, prefixes), window)
    large = held.where("size(long) > 0").select("doc_id", "rid", "text", "long")
    if large.isEmpty():
        return out
    again = lists_of(key_rows(large, window, prefixes, "substring_longer"), group_words)
    large = stored(large.withColumnRenamed("long", "before").join(again, "doc_id"), "substring_large")
    return out.unionByName(tree_ranges(stretch_rows(large, window, prefixes), window)).unionByName(whole_window_ranges(large, window, prefixes))


def cut_words(text: bytes, ranges) -> list[bytes]:
    """The words outside the ranges."""
    out, ws, done = [], text.split(), 0
    for lo, hi in sorted(ranges):
        out += ws[done:lo]
        done = max(done, hi)
    return out + ws[done:]


def substring_dedup(docs: DataFrame, window: int = WINDOW, prefixes: tuple[int, int] = PREFIXES, group_words: int = GROUP_WORDS, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Remove every word that lies in a window whose words also start in a document of smaller id.

    Returns ``doc_id, n_words, n_removed, kept_sha256`` (and the kept ``text``
    with ``with_text``) for every input row.  Windows are judged on the input.
    The second prefix is longer than the first and at most twice as long.
    Null texts have no words; a row without id is never a partner and keeps
    its words; rows of one id don't remove each other, and a row that occurs
    twice is returned twice; a text of any length is worked on whole; empty
    tables give empty results; further columns, of whatever names, are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = key_rows(docs.where("doc_id is not null"), window, prefixes, "substring_keys")
    held = stored(docs.join(lists_of(found, group_words), "doc_id").withColumn("rid", F.xxhash64("text")), "substring_held")
    ranges = repeated_passages(held, window, prefixes, group_words)
    ranges = ranges.groupBy("doc_id", "rid").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    found = held.select("doc_id", "rid", "text").dropDuplicates(["doc_id", "rid"])

    def cut(batches):
        for batch in words.text_slices(batches, 2):
            removed, digests, texts = [], [], []
            for text, rs in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                kept = cut_words(text.encode(), [(r["lo"], r["hi"]) for r in rs])
                removed.append(len(text.encode().split()) - len(kept))
                texts.append(b" ".join(kept))
                digests.append(hashlib.sha256(texts[-1]).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(digests, pa.string())] + [pa.array(texts, pa.binary()).cast(pa.string())] * with_text,
                                             ["doc_id", "rid", "n_removed", "cut_sha256"] + ["cut_text"] * with_text)

    more = ", cut_text string" if with_text else ""
    changed = found.join(ranges, ["doc_id", "rid"]).select("doc_id", "rid", "text", "ranges").mapInArrow(cut, "doc_id long, rid long, n_removed long, cut_sha256 string" + more)

    def whole(batches):
        for batch in words.text_slices(batches):
            texts = [b" ".join(t.encode().split()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([t.count(b" ") + 1 if t else 0 for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
                                             + [pa.array(texts, pa.binary()).cast(pa.string())] * with_text, ["doc_id", "rid", "n_words", "whole_sha256"] + ["whole_text"] * with_text)

    base = docs.withColumn("rid", F.xxhash64("text")).mapInArrow(whole, "doc_id long, rid long, n_words long, whole_sha256 string" + more.replace("cut", "whole"))
    out = base.join(changed, ["doc_id", "rid"], "left")
    cols = ["doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("cut_sha256", "whole_sha256").alias("kept_sha256")]
    return out.select(*cols, *([F.coalesce("cut_text", "whole_text").alias("text")] if with_text else []))
