"""Operator 4: near duplicates by BagMinHash over multisets of word shingles.

Signature. A shingle that occurs c times weighs c. Weights are discretised at the integers and grouped in dyadic
intervals [0,1), [1,2), [2,4), ...; for each shingle and interval a Poisson process of points, seeded by both, has rate
REGISTERS x the interval's length. A point has a time, a weight level inside its interval and a register; it belongs to
a text when its level lies below the shingle's count there. A register keeps the earliest time of the points that fall
on it, so two texts agree in a register with probability equal to their weighted Jaccard similarity. The processes run
only to a time that all registers are expected to be filled by, and longer for the few texts where one is not.

Candidates. Texts with equal multisets are one class, named by 128 bits of a digest. BANDS bands of ROWS registers give
buckets. In each bucket the first class (by a hash that differs from band to band) is the pivot, and all others that are
not yet in its component are verified against it by exact multiset overlap. Buckets that then still hold several
components are worked off inside tasks, from which only links leave: a bucket's classes are cut into blocks by the size of
their sets, and a task compares members outside of the pivot's component with the members of other components, a pair of
blocks at a time. Distance 1 - J is a metric, so only those within 1 - T of each other's distance to the pivot can be
linked. No component is lost, and a large group of near copies, which the pivots of several bands connect, costs a few
comparisons a member. Overlaps are counted on 32 bits of each shingle's hash: two different shingles of a pair of texts of
n words agree by chance with n^2 / 2^32, each of which shifts the similarity by less than 1 / n.

Components of the links come from repeated minimum labels and pointer jumping, each round written to the shared folder.

Edge cases: null, empty and blank texts have no words and form one class; texts of fewer than five words are one
shingle; repeated rows are members of one class; a null doc_id is never a representative unless it is alone; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from skyloom.llm.common import bounded_batches, fresh, narrow, workspace, written
from skyloom.llm.shingles import mix, multisets, shingle_hashes, words_of

REGISTERS, BANDS, ROWS = 64, 16, 4
THRESHOLD = 0.8
#: Distinct shingles of the sets of a block, on average; two blocks are compared at a time.
BLOCK = 1 << 17
#: Bands that are worked on together; what one step connects, the next need not compare.
STEPS = ((0, 1), (1, 4), (4, BANDS))
SLICE_BYTES = 1 << 17
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _times(k: int) -> np.uint64:
    return np.uint64(k * int(_STEP) % (1 << 64))


def _uniform(z: np.ndarray) -> np.ndarray:
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(doc: np.ndarray, h: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """(n, REGISTERS) array of the bits of the earliest times; texts without shingles have all ones."""
    out = np.full(n * REGISTERS, 0xFFFFFFFF, np.uint64)
    weight = np.bincount(doc, count, n)
    todo = np.flatnonzero(weight > 0)
    limit = (np.log(REGISTERS) + 4) / np.maximum(weight, 1)
    while len(todo):
        mine = np.isin(doc, todo) if len(todo) < n else np.ones(len(doc), bool)
        d, x, c = doc[mine], h[mine], count[mine]
        keys = []
        level = 0
        while len(d):  # interval 0 is [0,1), interval k is [2^(k-1), 2^k)
            low = 0 if level == 0 else 1 << (level - 1)
            rate = REGISTERS * max(1, low)
            state = mix(x + _times(level + 1))
            t, who = np.zeros(len(d)), np.arange(len(d))
            while len(who):
                state = mix(state + _STEP)
                t = t - np.log(_uniform(state)) / rate
                live = t < limit[d[who]]
                who, t, state = who[live], t[live], state[live]
                point = mix(state ^ np.uint64(0xD6E8FEB86659FD93))
                if low > 1:
                    ok = low + ((point >> np.uint64(32)).astype(np.float64) * 2.0**-32 * low).astype(np.int64) < c[who]
                    reg, tt, dd = (point[ok] % np.uint64(REGISTERS)).astype(np.int64), t[ok], d[who[ok]]
                else:
                    reg, tt, dd = (point % np.uint64(REGISTERS)).astype(np.int64), t, d[who]
                keys.append(((dd * REGISTERS + reg).astype(np.uint64) << np.uint64(32)) | tt.astype(np.float32).view(np.uint32).astype(np.uint64))
            more = c > max(1, 2 * low)
            d, x, c = d[more], x[more], c[more]
            level += 1
        k = np.sort(np.concatenate(keys))
        slot = (k >> np.uint64(32)).astype(np.int64)
        first = np.concatenate([[True], slot[1:] != slot[:-1]])
        out[slot[first]] = k[first] & np.uint64(0xFFFFFFFF)
        open_ = (out.reshape(n, REGISTERS)[todo] == 0xFFFFFFFF).any(1)
        todo = todo[open_]
        limit[todo] *= 3
    return out.reshape(n, REGISTERS)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(n, BANDS) hashes of ROWS registers each."""
    z = np.zeros((len(sig), BANDS), np.uint64)
    for r in range(ROWS):
        z = mix(z + sig[:, r::ROWS][:, :BANDS] + _times(r + 1))
    return z


ROW_SCHEMA = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("cls", pa.binary()), ("bands", pa.list_(pa.int64())), ("hashes", pa.binary()), ("counts", pa.binary())])


def _prepare(batches):
    """doc_id, digest of the text, class digest, band keys and the multiset (32-bit hashes, ascending, and counts)."""
    for b in batches:
        a, rows = 0, b.column(1)
        while a < len(rows):
            e, size, texts = a, 0, []
            while e < len(rows) and (e == a or size < SLICE_BYTES):
                texts.append(words_of(rows[e].as_py()))
                size += len(texts[-1])
                e += 1
            n = e - a
            doc, h, c = multisets(*shingle_hashes(texts), n)
            keys = band_keys(signatures(doc, h, c, n)).astype(np.int64)
            cut = np.searchsorted(doc, np.arange(n + 1))
            small = (h >> np.uint64(32)).astype(np.uint32)
            cls, hashes, counts = [], [], []
            for i in range(n):
                s, k = small[cut[i] : cut[i + 1]], c[cut[i] : cut[i + 1]].astype(np.uint32)
                cls.append(hashlib.blake2b(h[cut[i] : cut[i + 1]].tobytes() + k.tobytes(), digest_size=16).digest())
                hashes.append(s.tobytes())
                counts.append(b"" if (k == 1).all() else k.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0)[a:e], b.column(2)[a:e], pa.array(cls, pa.binary()), pa.array(list(keys), pa.list_(pa.int64())), pa.array(hashes, pa.binary()), pa.array(counts, pa.binary())], schema=ROW_SCHEMA)
            a = e


def overlap(h1: bytes, c1: bytes, h2: bytes, c2: bytes) -> float:
    """Weighted Jaccard similarity of two multisets."""
    a, b = np.frombuffer(h1, np.uint32), np.frombuffer(h2, np.uint32)
    x = np.frombuffer(c1, np.uint32).astype(np.int64) if c1 else np.ones(len(a), np.int64)
    y = np.frombuffer(c2, np.uint32).astype(np.int64) if c2 else np.ones(len(b), np.int64)
    keys = np.concatenate([a, b])
    order = np.argsort(keys, kind="stable")
    k, w = keys[order], np.concatenate([x, y])[order]
    both = np.flatnonzero(k[1:] == k[:-1])
    shared = np.minimum(w[both], w[both + 1]).sum()
    total = x.sum() + y.sum()
    return float(shared / (total - shared)) if total else 1.0


@F.pandas_udf(DoubleType())
def _similarity(h1: pd.Series, c1: pd.Series, h2: pd.Series, c2: pd.Series) -> pd.Series:
    return pd.Series([overlap(*r) for r in zip(h1, c1, h2, c2)], dtype="float64")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with their similarity j; each side of a pair is looked up by its own join."""
    left = sets.select(F.col("cls").alias("a"), F.col("hashes").alias("h1"), F.col("counts").alias("c1"))
    right = sets.select(F.col("cls").alias("b"), F.col("hashes").alias("h2"), F.col("counts").alias("c2"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", _similarity("h1", "c1", "h2", "c2").alias("j"))


def components(links: DataFrame) -> DataFrame:
    """(node, label): label is the least node of its connected component. links: (a, b), any direction."""
    edges = written(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "cc-edges")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "cc-labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        new = written(step.join(jump, "next").select("node", F.least("next", "far").alias("label"), (F.least("next", "far") < F.col("label")).alias("moved")), "cc-labels")
        labels = new.select("node", "label")
        if new.where("moved").isEmpty():
            return labels


def with_labels(rows: DataFrame, labels: DataFrame | None, node: str, name: str) -> DataFrame:
    """rows with the component of a node; a node without links is its own."""
    if labels is None:
        return rows.withColumn(name, F.col(node))
    return rows.join(labels.select(F.col("node").alias(node), F.col("label").alias(name)), node, "left").withColumn(name, F.coalesce(name, node))


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """labels (node, label) after further links (a, b). Only links between different components count, and their
    components are found on labels instead of nodes, so that a large component costs its links once."""
    if labels is None:
        return components(links)
    between = with_labels(with_labels(links.select("a", "b"), labels, "a", "la"), labels, "b", "lb").where("la <> lb")
    joined = components(between.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct())
    nodes = labels.select("node").union(links.select("a")).union(links.select("b")).distinct()
    return written(with_labels(with_labels(nodes, labels, "node", "own"), joined, "own", "label").select("node", "label"), "cc-merged")


LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("j", pa.float64())])


def block_links(rows: list[dict], threshold: float) -> list[tuple[bytes, bytes, float]]:
    """Links between members of different components on the two sides of a pair of blocks, with exact overlaps.

    All sets of side 1 are one sorted list of (hash, member, count); a set of side 0 finds its hashes there, and the
    lesser counts are summed by member. Memory follows the sets and one member's matches.
    """
    a, b = ([r for r in rows if r["side"] == k] for k in (0, 1))
    if not a or not b:
        return []

    def sets(side):
        h = [np.frombuffer(r["hashes"], np.uint32) for r in side]
        return h, [np.frombuffer(r["counts"], np.uint32).astype(np.int64) if r["counts"] else np.ones(len(x), np.int64) for r, x in zip(side, h)]

    (ha, ca), (hb, cb) = sets(a), sets(b)
    weight = np.array([c.sum() for c in cb])
    order = np.argsort(keys := np.concatenate(hb), kind="stable")
    keys, who, count = keys[order], np.repeat(np.arange(len(b)), [len(x) for x in hb])[order], np.concatenate(cb)[order]
    mine = {m: i for i, m in enumerate({r["mine"] for r in rows})}
    part, far = np.array([mine[r["mine"]] for r in b]), 1 - threshold + 1e-9
    to_pivot = np.array([np.nan if r["j"] is None else r["j"] for r in b], float)
    out = []
    for r, h, c in zip(a, ha, ca):
        total = c.sum()
        open_ = (part != mine[r["mine"]]) & (np.minimum(weight, total) >= threshold * np.maximum(weight, total))
        if r["j"] is not None:
            open_ &= ~(np.abs(to_pivot - r["j"]) > far)
        if not open_.any():
            continue
        low, high = np.searchsorted(keys, h), np.searchsorted(keys, h, "right")
        n = high - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        shared = np.bincount(who[at], np.minimum(count[at], np.repeat(c, n)), len(b))
        j = shared / (total + weight - shared)
        out += [(r["cls"], b[k]["cls"], float(j[k])) for k in np.flatnonzero(open_ & (j >= threshold)).tolist()]
    return out


def _stream_links(threshold: float):
    """Links of each pair of blocks; its rows come one after the other, so one pair is in memory at a time."""

    def run(batches):
        key, rows, found = None, [], []
        for batch in batches:
            for r in batch.to_pylist():
                mine = (r["band"], r["key"], r["i"], r["k"])
                if mine != key:
                    found += block_links(rows, threshold)
                    key, rows = mine, []
                rows.append(r)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), LINKS)], schema=LINKS)
                found = []
        if found := block_links(rows, threshold):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), LINKS)], schema=LINKS)

    return run


def open_links(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, j): links of members outside of their pivot's component to all members of other components of the bucket.

    Either side is cut into blocks by the size of the sets; a task compares one block with another, so a bucket of any
    size is many tasks of bounded memory, and a member moves once for each block of the other side.
    """
    width = F.col("width") + 16
    blocks = lambda who: F.greatest(F.lit(1), F.ceil(F.sum(F.when(who, width).otherwise(0)) / BLOCK)).cast("int")
    size = members.groupBy("band", "key").agg(blocks(F.lit(True)).alias("nb"), blocks(F.col("mine") != F.col("its")).alias("na"))
    m = members.join(size, ["band", "key"])
    h = F.xxhash64("cls", F.lit(1))
    a = m.where("mine <> its").withColumn("i", F.pmod(h, F.col("na")).cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumn("side", F.lit(0))
    b = m.withColumn("k", F.pmod(h, F.col("nb")).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("na") - 1))).withColumn("side", F.lit(1))
    names = ["band", "key", "i", "k", "side", "cls", "mine", "j"]
    rows = a.select(*names).unionByName(b.select(*names)).join(sets, "cls")
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "band", "key", "i", "k").sortWithinPartitions("band", "key", "i", "k").mapInArrow(_stream_links(threshold), "a binary, b binary, j double")


def class_links(classes: DataFrame, rows: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(a, b): verified links that connect all classes whose similarity reaches threshold; and (node, label): components.

    classes: cls, width (distinct shingles), bands; rows: cls, hashes, counts, at least one of each class."""
    bands = classes.select("cls", "width", F.posexplode("bands").alias("band", "key"))
    # the pivot of a bucket: least in a hash of class and band, so bands have different pivots
    first = F.min(F.struct(F.xxhash64("cls", "band").alias("r"), F.col("cls").alias("pivot"))).alias("p")
    crowded = bands.groupBy("band", "key").agg(F.count("*").alias("n"), first).where("n > 1").select("band", "key", F.col("p.pivot").alias("pivot"))
    active = written(bands.join(crowded, ["band", "key"]).where("cls <> pivot"), "nd-members")
    own = rows.join(active.select("cls").union(active.select("pivot")).distinct(), "cls", "left_semi")
    sets = written(own.groupBy("cls").agg(F.first(F.struct("hashes", "counts")).alias("s")).select("cls", "s.hashes", "s.counts"), "nd-sets", "snappy")
    out, labels, seen = None, None, None
    for low, high in STEPS:
        now = active.where((F.col("band") >= low) & (F.col("band") < high))
        now = with_labels(with_labels(now, labels, "cls", "mine"), labels, "pivot", "its").where("mine <> its")
        known = written(verified(now.select(F.col("cls").alias("a"), F.col("pivot").alias("b")).distinct(), sets), "nd-stars")
        near = known.where(F.col("j") >= threshold).select("a", "b")
        out = near if out is None else out.union(near)
        seen = known if seen is None else seen.union(known)
        labels = merged(labels, near)
    # what is left: members in other components than their pivot's, against the other components of the bucket
    members = written(with_labels(with_labels(active, labels, "cls", "mine"), labels, "pivot", "its").join(seen.select(F.col("a").alias("cls"), F.col("b").alias("pivot"), "j"), ["cls", "pivot"], "left"), "nd-left")
    open_ = members.where("mine <> its").select("band", "key").distinct()
    rest = written(open_links(members.join(open_, ["band", "key"], "left_semi"), sets, threshold).select("a", "b").distinct(), "nd-rest")
    return out.union(rest), merged(labels, rest)


def _digest(text):
    """128 bits of a text; null for null."""
    return F.unhex(F.md5(text.cast("string").cast("binary")))


def _grouped(docs: DataFrame, threshold: float, digests: bool) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, digest of the text if asked for, cls) and their classes (cls, label of the group, class_id, ...)."""
    bounded_batches(docs.sparkSession)
    digest = _digest(F.col("text")) if digests else F.lit(None).cast("binary")
    rows = narrow(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), digest.alias("digest"))
    rows = rows.mapInArrow(_prepare, "doc_id long, digest binary, cls binary, bands array<long>, hashes binary, counts binary")
    with workspace() as keep:  # the sets go when the classes stand
        rows = written(rows, "nd-rows", "snappy")
        # a row for each class: equal multisets have equal bands
        copies = written(
            rows.groupBy("cls").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first(F.struct((F.length("hashes") / 4).cast("long").alias("width"), "bands")).alias("s")).select("cls", "least", "copies", "s.width", "s.bands"), "nd-classes"
        )
        links, groups = class_links(copies.where("width > 0").select("cls", "width", "bands"), rows.where(F.length("hashes") > 0).select("cls", "hashes", "counts"), threshold)
        links = written(links.distinct(), "nd-links")
        degree = links.union(links.select("b", "a")).distinct().groupBy(F.col("a").alias("cls")).agg(F.count("*").alias("links"))
        named = copies.select("cls", "least", "copies").join(groups.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls")).join(degree, "cls", "left")
        heads = named.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"))
        classes = written(named.join(heads, "label").select("cls", "label", "class_id", "class_size", "copies", F.coalesce("links", F.lit(0)).alias("links")), "nd-named")
        rows = written(rows.select("doc_id", "digest", "cls"), "nd-ids")
        keep += [rows, classes]
    return rows, classes


def of_class(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """rows with the columns of their class. Classes with more than one row in a hundred, which are a hundred at most, are
    broadcast; the rows of all others move to their class."""
    total = classes.agg(F.sum("copies").alias("t"))
    big = classes.join(F.broadcast(total), F.col("copies") * 100 > F.col("t")).drop("t")
    rest = classes.join(F.broadcast(total), F.col("copies") * 100 <= F.col("t")).drop("t")
    few = rows.join(F.broadcast(big.select("cls")), "cls", "left_anti")
    return rows.join(F.broadcast(big), "cls").unionByName(few.join(rest, "cls"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (least doc_id of its group), copies (rows with an equal multiset), links: a row for each row of docs.

    links counts the other classes that a row's class is linked to directly among the verified links;
    pairs that are in one component already are not verified, so it says how a group was connected, not all links in it.
    class_id is null
    for a group whose rows all have a null doc_id, and groups that hold different texts of one doc_id can share it.
    """
    rows, classes = _grouped(docs, threshold, False)
    return of_class(rows, classes).select("doc_id", "class_id", "class_size", "copies", "links")


def without_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each group: of its rows with the least doc_id the first by a digest of the text; all columns of docs.

    Groups are told apart by their label, never by doc_id, which may be null or stand for several texts. Rows with equal
    doc_id and text are in one group, so these two name a survivor; of rows that repeat both, one is kept.
    """
    rows, classes = _grouped(docs, threshold, True)
    digest, least = fresh(docs, "digest", "least")
    first = of_class(rows, classes).where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("label").agg(F.min("digest").alias(digest), F.first("class_id").alias(least))
    # min passes over nulls: a null text is the survivor only of a group that has no other
    keep = written(first.select(least, digest), "nd-keep")
    same = docs["doc_id"].cast("long").eqNullSafe(keep[least]) & _digest(docs["text"]).eqNullSafe(keep[digest])
    out = docs.join(keep, same, "left_semi")
    # rows that share doc_id and text: one of them
    keyed = out.withColumn(digest, _digest(F.col("text")))
    if keyed.groupBy("doc_id", digest).agg(F.count("*").alias(least)).where(F.col(least) > 1).isEmpty():
        return out
    return keyed.dropDuplicates(["doc_id", digest]).drop(digest)


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT r, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
c AS (SELECT r, g, count(*) AS n FROM s GROUP BY r, g),
t AS (SELECT r, sum(n) AS t, md5(string_agg(g || ' ' || n, '|' ORDER BY g)) AS k FROM c GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, sum(least(a.n, b.n)) AS shared FROM c a JOIN c b USING (g) WHERE a.r <> b.r GROUP BY a.r, b.r),
e AS (SELECT x, y FROM p JOIN t a ON a.r = x JOIN t b ON b.r = y WHERE shared >= 0.8 * (a.t + b.t - shared)),
reach(r, q) AS (SELECT r, r FROM t UNION SELECT reach.r, e.y FROM reach JOIN e ON e.x = reach.q),
g AS (SELECT reach.r, min(d.doc_id) AS class_id, count(*) AS class_size FROM reach JOIN d ON d.r = q GROUP BY reach.r),
b AS (SELECT min(doc_id) AS class_id, count(*) AS n FROM d WHERE len(w) = 0)
SELECT d.doc_id, CASE WHEN len(w) = 0 THEN b.class_id ELSE g.class_id END AS class_id, CASE WHEN len(w) = 0 THEN b.n ELSE class_size END::BIGINT AS class_size,
  CASE WHEN len(w) = 0 THEN b.n ELSE count(*) OVER (PARTITION BY k) END::BIGINT AS copies
FROM d CROSS JOIN b LEFT JOIN g USING (r) LEFT JOIN t USING (r)
"""
