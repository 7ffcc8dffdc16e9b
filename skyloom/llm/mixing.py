"""Operator 7: mixing sources to target weights by weighted fair queueing.

Each source is a queue whose documents come in an order shuffled by a hash of doc_id (of the text where it is null), and a
source can be read `repeats` times. A copy's virtual finish time is the number of words of its source up to and with it,
divided by the source's target. All copies of all sources are sorted by finish time, in ranges over the cluster, which
interleaves the sources at their weights, and the sorted sequence is cut where its words reach the budget, the sum of the
targets. Copies that cross a tick of virtual time are served in parts, one for each tick, so that a long document does not
hold up the sources that wait for it: what a source gets differs from its target by less than a tick, 1 / TICKS of it.

Prefix sums run in two steps: per source in buckets of the shuffled order, whose number follows the source's rows, then over
the parts of the range sort. Neither a source with a third of all rows nor the whole sequence is ever one window.

Edge cases: a null or blank text has size 0 and is never taken; null is a source of its own, last in order; rows with
one doc_id are separate documents, ordered by size, and equal ones share what they take in an arbitrary but constant way;
an empty table gives an empty result; extra columns, whatever their names, are carried along by mixed_sequence and ignored
otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.common import fresh, narrow, workspace, written

#: Fixed values of the contract: weights by order of source, share of all words, most repeats.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
BUCKET_ROWS = 8192
#: Ticks of virtual time until the budget is reached.
TICKS = 1024
#: Rows of a part of the range sort.
PART_ROWS = 1 << 20
SEED = "mix"


def shuffle_key(doc_id, text):
    """52 bits of md5, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), text.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """source, source_size, rows, target: weighted shares of the budget, none above repeats x its source's size.

    Water filling: a source is capped when the common level (budget per unit of weight) reaches its cap per unit of
    weight, so in the order of that ratio the level after k capped sources is (budget - their caps) / (weights of the
    rest), and the first source whose ratio is not below it ends the search. One row a source.
    """
    one = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(one) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(repeats))).withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    s = s.withColumn("level", (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest))
    s = s.withColumn("final", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(every))
    return s.select("source", "source_size", "rows", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("w") * F.col("final.level"))).alias("target"))


def sized(docs: DataFrame, row) -> DataFrame:
    """row, doc_id, source, size, k of each row of docs."""
    size = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"), shuffle_key(F.col("doc_id"), F.col("text")).alias("k"))


def queued(sizes: DataFrame, weights, share: float, repeats: int) -> DataFrame:
    """sizes with source_size, target and start: the words of the source before a row, in shuffled order."""
    targets = written(source_targets(sizes, weights, share, repeats).select(F.col("source").alias("s"), "source_size", "target", "rows"), "mix-targets")
    rows = sizes.join(targets, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    bucket = F.floor(F.col("k") / F.lit(float(1 << 52)) * F.ceil(F.col("rows") / F.lit(BUCKET_ROWS)))
    rows = rows.withColumn("bucket", bucket).drop("rows")
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("source", "bucket").orderBy("k", F.col("doc_id").asc_nulls_first(), "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0))).join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    return rows.withColumn("start", F.col("ahead") + F.col("before")).drop("s", "b", "bucket", "ahead", "before", "k")


def served(queue: DataFrame, repeats: int) -> DataFrame:
    """queue with copy, finish and taken: what the sorted and cut sequence takes of each copy that has words."""
    spark = queue.sparkSession
    tick = F.col("target") / F.lit(float(TICKS))
    copies = queue.where("size > 0 AND target > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    copies = copies.withColumn("a", F.col("start") + F.col("copy") * F.col("source_size")).withColumn("e", F.col("a") + F.col("size"))
    at = F.transform(F.sequence(F.floor(F.col("a") / tick), F.ceil(F.col("e") / tick) + 1), lambda m: F.floor(m * tick))
    ends = F.array_distinct(F.concat(F.filter(at, lambda t: (t > F.col("a")) & (t < F.col("e"))), F.array("e")))
    parts = copies.select("row", "source", "target", "copy", "a", F.posexplode(ends).alias("i", "end"), ends.alias("ends"))
    parts = parts.select("row", "source", "copy", "end", (F.col("end") - F.coalesce(F.get("ends", F.col("i") - 1), F.col("a"))).alias("words"), (F.col("end") / F.col("target")).alias("finish"))
    order = [F.col("finish"), F.col("source").asc_nulls_last(), F.col("end")]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-queue.count() // PART_ROWS))
    sequence = written(parts.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "mix-sequence")
    # words before each part: a row for each part, then before each row of it
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sequence.groupBy("part").agg(F.sum("words").alias("w")).select("part", F.coalesce(F.sum("w").over(ahead), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # the budget is a multiple of a half up to rounding, so a quarter more rounds alike whatever the order of the sum
    budget = queue.groupBy("source").agg(F.first("target").alias("t")).agg(F.floor(F.sum("t") + 0.25).alias("budget"))
    cut = sequence.withColumn("within", F.coalesce(F.sum("words").over(within), F.lit(0))).join(F.broadcast(sums), "part").join(F.broadcast(budget))
    taken = F.greatest(F.lit(0), F.least(F.col("words"), F.col("budget") - F.col("ahead") - F.col("within")))
    return cut.groupBy("row", "copy").agg(F.sum(taken).alias("taken"), F.max("finish").alias("finish"))


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, virtual_finish (of the first copy; null without words): one row
    for each row of docs."""
    with workspace() as keep:
        sizes = written(sized(narrow(docs, "doc_id", "text", "source"), F.monotonically_increasing_id()), "mix-sizes")
        queue = written(queued(sizes, weights, share, repeats), "mix-queue")
        each = written(served(queue, repeats).groupBy("row").agg(F.sum("taken").alias("taken"), F.min("finish").alias("virtual_finish")), "mix-taken")
        keep += [queue, each]
    return queue.join(each, "row", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "virtual_finish")


def mixed_sequence(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """The rows of docs that the mix takes, whole, one for each copy, in order of virtual finish time.

    A copy that the cut goes through stays when at least half of it is taken. Each row decides for itself, whatever ids
    it shares with others.
    """
    row, finish, copy = fresh(docs, "row", "finish", "copy")
    with workspace() as keep:
        keyed = written(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
        sizes = written(sized(narrow(keyed, "doc_id", "text", "source", row), F.col(row)), "mix-sizes")
        queue = written(queued(sizes, weights, share, repeats), "mix-queue")
        whole = served(queue, repeats).join(queue.select("row", "size"), "row").where("2 * taken >= size")
        whole = written(whole.select(F.col("row").alias(row), F.col("finish").alias(finish), F.col("copy").alias(copy)), "mix-copies")
        keep += [keyed, whole]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.join(whole, row).repartitionByRange(n, finish, row).sortWithinPartitions(finish, row, copy).select(*[keyed[c] for c in docs.columns])


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, row_number() OVER () AS row,
  ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, text, '')), 1, 13))::BIGINT AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM s),
r AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / w AS ratio FROM w),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT source, source_size, least(cap, w * (SELECT level FROM l WHERE ratio >= level ORDER BY ratio LIMIT 1)) AS target FROM l),
p AS (SELECT d.row, d.doc_id, d.source, d.size, t.source_size, t.target,
  (sum(d.size) OVER (PARTITION BY d.source ORDER BY k, doc_id NULLS FIRST, size, row ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, start + copy * source_size AS a, start + copy * source_size + size AS e, target / 1024.0::DOUBLE AS tick FROM p, range(0, 2) AS x(copy) WHERE size > 0 AND target > 0),
q AS (SELECT row, source, copy, target, a, unnest(list_distinct(list_append(list_filter(list_transform(range(floor(a / tick)::BIGINT, ceil(e / tick)::BIGINT + 2), lambda m: floor(m * tick)::BIGINT), lambda z: z > a AND z < e), e))) AS stop FROM c),
o AS (SELECT *, stop - lag(stop, 1, a) OVER (PARTITION BY row, copy ORDER BY stop) AS words, stop / target AS finish FROM q),
b AS (SELECT *, (sum(words) OVER (ORDER BY finish, source NULLS LAST, stop ROWS UNBOUNDED PRECEDING) - words)::BIGINT AS before FROM o),
g AS (SELECT row, sum(greatest(0, least(words, (SELECT floor(sum(target) + 0.25)::BIGINT FROM t) - before)))::BIGINT AS taken FROM b GROUP BY row)
SELECT doc_id, size, source_size, round(target, 3) AS target, coalesce(taken, 0)::BIGINT AS taken, round(CASE WHEN size > 0 AND target > 0 THEN (start + size) / target END, 6) AS virtual_finish
FROM p LEFT JOIN g USING (row)
"""
