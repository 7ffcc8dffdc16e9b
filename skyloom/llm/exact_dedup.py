"""Operator 2 (DataFrame functions only): exact duplicates through an extendible-hash index on shared files.

Postings (row, hash, digest, lot) of every normalised text are written once; a lot is one of LOTS shares that rows fall in
by their id, so that a group of copies of any size is many small groups on its way. Map tasks combine the copies of a lot
to one entry: hash, digest, the text itself, how many rows, and the best of them.

A directory over the leading bits of the hash, a table like all else, doubles until no bucket holds more than `capacity`
hashes: a step looks at STEP more bits of the buckets that are overfull. Entries are routed to the bucket of their range of
hashes, and a bucket's owner task does the rest: it sorts its range, chains the entries of one hash, compares the bytes of
neighbours in a chain, so that slots of the chain are texts, and sums up rows and the best row of each slot. The index
files hold the slots; every row finds its slot by hash, digest and lot.

Should two texts ever share hash and SHA-256 but not their bytes, the owner raises an error rather than merge them.

Edge cases: a null text counts as empty, empty texts are equal to each other; a null doc_id comes after all others;
of fully repeated rows exactly one stays; an empty table gives an empty result; extra columns, whatever their names, are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.common import narrow, scratch_path, written

#: The characters that normalisation deletes.
BLANKS = " \t\n\x0b\x0c\r"
#: Hashes that a bucket may hold before it splits.
CAPACITY = 1 << 12
#: Bits that one step of the directory looks at; its histogram has at most 2 ** STEP rows a bucket.
STEP = 12
MAX_DEPTH = 60
#: Shares that the copies of one text are dealt into.
LOTS = 64
#: Rows of the directory up to which it is broadcast (some 30 MB); a larger one is joined by shuffling.
BROADCAST_ROWS = 1 << 20


def normalised(text):
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), BLANKS, "")


def prefix(h, depth):
    """The leading `depth` bits of h."""
    return F.when(depth == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", h, (F.lit(64) - depth).cast("int")))


def build_directory(hashes: DataFrame, capacity: int) -> DataFrame:
    """Buckets (depth int, prefix long, n long) of an extendible-hash directory over the distinct values of column h.

    A bucket doubles bit by bit while it is overfull. Counts for STEP more bits come from one aggregation over the rows of
    the buckets that are still overfull; sums over every shorter prefix of these decide which depth suffices. No row
    reaches the driver, and the directory grows with the number of buckets.
    """
    done, open_, base = None, None, 0
    while True:
        top = min(base + STEP, MAX_DEPTH)
        rows = hashes.select("h")
        if open_ is not None:
            rows = rows.withColumn("prefix", prefix(F.col("h"), F.lit(base))).join(open_, "prefix", "left_semi")
        leaves = rows.groupBy(prefix(F.col("h"), F.lit(top)).alias("leaf")).agg(F.count("*").alias("n"))
        nodes = leaves.select(F.explode(F.sequence(F.lit(base), F.lit(top))).alias("depth"), "leaf", "n")
        nodes = nodes.groupBy("depth", F.call_function("shiftrightunsigned", F.col("leaf"), (F.lit(top) - F.col("depth")).cast("int")).alias("prefix")).agg(F.sum("n").alias("n"))
        nodes = written(nodes, "dedup-directory")
        # both halves of an overfull bucket are buckets, empty ones too; halves below a bucket that suffices are not
        halves = nodes.where((F.col("n") > capacity) & (F.col("depth") < top)).select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
        reached = halves.join(nodes, ["depth", "prefix"], "left").select("depth", "prefix", F.coalesce("n", F.lit(0)).alias("n"))
        if base == 0:
            reached = nodes.where("depth = 0").select("depth", "prefix", "n").unionByName(reached)
        settled = reached.where((F.col("n") <= capacity) | (F.col("depth") == MAX_DEPTH))
        done = settled if done is None else done.unionByName(settled)
        open_ = reached.where((F.col("n") > capacity) & (F.col("depth") == top)).select("prefix")
        base = top
        if base == MAX_DEPTH or open_.isEmpty():
            return written(done.withColumn("depth", F.col("depth").cast("int")), "dedup-directory")


def with_bucket(entries: DataFrame, directory: DataFrame) -> DataFrame:
    """Add the bucket of each entry: the first hash of its range, as an unsigned number's bits."""
    depths = [r.depth for r in directory.select("depth").distinct().orderBy("depth").collect()]  # at most MAX_DEPTH + 1
    if not depths:
        return entries.withColumn("bucket", F.lit(0).cast("long"))
    table = directory.select(F.col("depth").alias("__depth"), F.col("prefix").alias("__prefix"))
    if directory.count() <= BROADCAST_ROWS:
        table = F.broadcast(table)
    keyed = entries.withColumn("__depth", F.explode(F.array(*[F.lit(d) for d in depths]))) if len(depths) > 1 else entries.withColumn("__depth", F.lit(depths[0]))
    keyed = keyed.withColumn("__prefix", prefix(F.col("h"), F.col("__depth"))).join(table, ["__depth", "__prefix"])
    return keyed.withColumn("bucket", F.when(F.col("__depth") == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.col("__prefix"), (F.lit(64) - F.col("__depth")).cast("int")))).drop("__depth", "__prefix")


def exact_duplicates(docs: DataFrame, capacity: int = CAPACITY, index_path: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of docs(doc_id, text)."""
    spark = docs.sparkSession
    norm = normalised(F.col("text"))
    keyed = narrow(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), norm.alias("norm"), F.length(F.coalesce("text", F.lit(""))).alias("cps")
    ).select("doc_id", "cps", "norm", F.xxhash64("norm").alias("h"), F.pmod(F.xxhash64("doc_id", "cps"), F.lit(LOTS)).cast("int").alias("lot"))
    postings = written(keyed.select("doc_id", "cps", "h", F.unhex(F.sha2(F.col("norm"), 256)).alias("sha"), "lot", F.monotonically_increasing_id().alias("row")), "dedup-postings")
    directory = build_directory(written(postings.select("h").distinct(), "dedup-hashes"), capacity)
    # the copies of a lot: the most code points, then the least id; how many rows are equal in both
    best = F.struct("cps", F.bitwise_not(F.coalesce("doc_id", F.lit((1 << 63) - 1))).alias("id"))
    entries = keyed.groupBy("h", "lot", "norm").agg(F.count(F.lit(1)).alias("n"), F.max(best).alias("best"))
    path = index_path or scratch_path(spark, "dedup-index")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    owned = with_bucket(entries.withColumn("sha", F.unhex(F.sha2(F.col("norm"), 256))), directory).repartition(parts, "bucket")
    chain = Window.partitionBy("bucket", "h").orderBy("sha", "norm")
    differs = F.when(F.row_number().over(chain) == 1, F.lit(0)).when(F.lag("norm").over(chain) == F.col("norm"), F.lit(0)).when(F.lag("sha").over(chain) == F.col("sha"), F.raise_error(F.lit("two texts with one SHA-256")).cast("int")).otherwise(F.lit(1))
    owned = owned.withColumn("differs", differs).drop("norm").withColumn("slot", F.sum("differs").over(chain.orderBy("sha").rangeBetween(Window.unboundedPreceding, 0)))
    slot = Window.partitionBy("bucket", "h", "slot")
    owned = owned.withColumn("group_size", F.sum("n").over(slot)).withColumn("best", F.max("best").over(slot))
    index = owned.select("bucket", "h", "slot", "lot", "sha", "group_size", F.col("best.cps").alias("keep_cps"), F.col("best.id").alias("keep_key"))
    index.sortWithinPartitions("bucket", "h", "slot", "lot").write.option("compression", "zstd").parquet(path)
    index = spark.read.schema(index.schema).parquet(path)
    found = postings.join(index.select("h", "sha", "lot", "group_size", "keep_cps", "keep_key"), ["h", "sha", "lot"])
    top = (F.col("cps") == F.col("keep_cps")) & (F.bitwise_not(F.coalesce("doc_id", F.lit((1 << 63) - 1))) == F.col("keep_key"))
    found = found.withColumn("kept", top)
    # rows that repeat one another in id, length and normalised text: the first of them stays
    repeats = written(postings.groupBy("h", "sha", "doc_id", "cps").agg(F.min("row").alias("first"), F.count("*").alias("tied")).where("tied > 1").select("h", "sha", F.col("doc_id").alias("__doc_id"), F.col("cps").alias("__cps"), "first"), "dedup-repeats")
    if not repeats.isEmpty():
        same = (found["h"] == repeats["h"]) & (found["sha"] == repeats["sha"]) & F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("cps") == F.col("__cps"))
        found = found.join(repeats, same, "left").select("doc_id", "group_size", "keep_key", found["sha"], (F.col("kept") & F.coalesce(F.col("row") == F.col("first"), F.lit(True))).alias("kept"))
    keep_id = F.when(F.bitwise_not("keep_key") != F.lit((1 << 63) - 1), F.bitwise_not("keep_key"))
    return found.select("doc_id", keep_id.alias("keep_id"), "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS cps, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT *, count(*) OVER (PARTITION BY norm) AS group_size,
  first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS rn FROM t
  WINDOW w AS (PARTITION BY norm ORDER BY cps DESC, doc_id ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, sha256(norm) AS text_sha256 FROM g
"""
