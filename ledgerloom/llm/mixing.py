"""Mixing sources to target weights.

Every document gets a hash-random key; within each source documents are
ordered by that key over fixed key ranges, the token counts are summed per
range, and a document's place in its source is the sum of the earlier ranges
plus a running sum inside its own.  A source of any size is so spread over
``ranges`` partitions, no group is ever held by one task, and the cut falls
exactly on the source's budget.  Budgets above a source's size repeat it.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.store import stored, unused

WEIGHT_CYCLE = (1, 2, 3)
MAX_EPOCHS = 3
#: Rows that a key range of a source holds at most on average; the hex digits of the key that name its range follow from it.
RANGE_ROWS = 4096


def water_fill(sizes: list[int], weights: list[int], total: int, epochs: int) -> list[Fraction]:
    """Targets in proportion to the weights, none above ``epochs`` times its size.

    What a cap cuts off is shared among the others by weight until no target is above its cap."""
    targets = [Fraction(0)] * len(sizes)
    open_ones, left = list(range(len(sizes))), Fraction(min(total, epochs * sum(sizes)))
    while open_ones:
        share = left / sum(weights[i] for i in open_ones)
        full = [i for i in open_ones if share * weights[i] > epochs * sizes[i]]
        if not full:
            for i in open_ones:
                targets[i] = share * weights[i]
            break
        for i in full:
            targets[i] = Fraction(epochs * sizes[i])
            left -= targets[i]
        open_ones = [i for i in open_ones if i not in full]
    return targets


def word_count(text) -> F.Column:
    """Number of runs of characters other than ``[\\x20\\x09-\\x0D]``; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        weights: dict | None = None, budget: int | None = None, max_epochs: int = MAX_EPOCHS, seed: str = "") -> DataFrame:
    """How many words of each document the mix takes.

    Returns ``doc_id, source, size, source_size, target, taken`` for every row.
    ``weights`` maps sources to whole weights; by default sources in order of
    code point, null last, weigh 1, 2, 3, repeating.  ``budget`` is the number
    of words of the whole mix, by default that of the input.

    The table of sources (one row each, the mix's own specification) is the
    only thing the driver sees.  Null or empty texts have size 0 and give 0; a
    null source is a source of its own; equal ids are told apart by nothing, so
    ties in key and id are ordered by size and share alike whatever their order.
    An empty table gives an empty result.  Other columns are ignored.
    """
    spark = docs.sparkSession
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = stored(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")).withColumn("key", key),
        "mix_rows",
    )
    n, digits = rows.count(), 1
    while RANGE_ROWS * 16**digits < n:
        digits += 1
    rows = rows.withColumn("part", F.substring("key", 1, digits))
    parts = stored(rows.groupBy("source", "part").agg(F.sum("size").alias("part_size")), "mix_parts")
    found = {r.source: int(r.n) for r in parts.groupBy("source").agg(F.sum("part_size").alias("n")).collect()}
    order = sorted(found, key=lambda s: (s is None, s or ""))
    weigh = [weights[s] if weights else WEIGHT_CYCLE[i % len(WEIGHT_CYCLE)] for i, s in enumerate(order)]
    goals = water_fill([found[s] for s in order], weigh, sum(found.values()) if budget is None else budget, max_epochs)
    plan = []
    for s, goal in zip(order, goals, strict=True):
        words = round(goal)  # the whole words nearest to the target
        full, rest = divmod(words, found[s]) if found[s] else (0, 0)
        plan.append((s, found[s], float(goal), full, rest))
    plan = spark.createDataFrame(plan, "source string, source_size long, target double, full_epochs long, rest long")
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("start", F.coalesce(F.sum("part_size").over(before), F.lit(0))).select(
        F.col("source").alias("p_source"), F.col("part").alias("p_part"), "start")
    placed = rows.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(starts, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("part") == F.col("p_part")))
    goal = plan.withColumnRenamed("source", "g_source")
    placed = placed.join(goal, F.col("source").eqNullSafe(F.col("g_source")))
    cut = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start") - F.col("ahead")))
    return placed.select("doc_id", "source", "size", "source_size", "target",
                         (F.col("full_epochs") * F.col("size") + cut).cast("long").alias("taken"))


def repeated(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix itself: each row as often as its own taken words fill it, the cut one rounded.

    A row finds its row of ``mixed`` by id, source and size, nulls alike.  Rows that
    share all three are told apart by nothing in the mix; they take the values
    there one each, the largest first, in order of text.  Rows without words take
    no space in the mix and are left out."""
    named = lambda i, s, n: F.to_json(F.struct(i.alias("i"), s.cast("string").alias("s"), n.alias("n")))
    times = mixed.where("size > 0").select(named(F.col("doc_id"), F.col("source"), F.col("size")).alias("__row"), F.round(F.col("taken") / F.col("size")).cast("int").alias("__t"))
    times = times.groupBy(F.col("__row").alias("__of")).agg(F.sort_array(F.collect_list("__t"), False).alias("__times"))
    row, place, epoch = (unused(c, docs.columns) for c in ("row", "place", "epoch"))
    of, each = unused("of", docs.columns), unused("each", docs.columns)
    times = times.select(F.col("__of").alias(of), F.col("__times").alias(each))
    rows = docs.withColumn(row, named(F.col(id_col), F.col(source_col), word_count(F.col(text_col))))
    rows = rows.withColumn(place, F.row_number().over(Window.partitionBy(row).orderBy(text_col)))
    out = rows.join(times, F.col(row) == F.col(of)).withColumn(each, F.get(each, F.col(place) - 1)).where(F.col(each) > 0)
    return out.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(each))).alias(epoch)).drop(epoch)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS w
  FROM d GROUP BY source),
r AS (
  SELECT *, coalesce(sum(3 * source_size) OVER o, 0) AS capped, sum(w) OVER (ORDER BY 3.0 * source_size / w DESC, source DESC) AS open_w,
         (SELECT sum(size) FROM d) AS total
  FROM s WINDOW o AS (ORDER BY 3.0 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT (total - capped) AS num, open_w AS den FROM r
  WHERE (total - capped) * w <= 3 * source_size * open_w ORDER BY 3.0 * source_size / w, source LIMIT 1),
t AS (
  SELECT source, source_size,
         CASE WHEN CAST(num AS HUGEINT) * w <= CAST(3 * source_size AS HUGEINT) * den
              THEN CAST(num * w AS DOUBLE) / CAST(den AS DOUBLE) ELSE CAST(3 * source_size AS DOUBLE) END AS target
  FROM s, level),
g AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(round_even(t.target, 0) AS BIGINT) AS words,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(CAST(d.doc_id AS VARCHAR)), d.doc_id
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0
            ELSE (words // source_size) * size + greatest(0, least(size, words % source_size - ahead)) END AS BIGINT) AS taken
FROM g
"""
