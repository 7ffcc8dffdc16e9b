"""Operator 1: content-addressed store of token ids.

Each text is encoded; a rolling hash over the id stream cuts it into chunks; a chunk is stored once under its
digest; a document is a recipe of chunk digests; Merkle roots over digests, recipes and manifest parts verify what is
read back, and missing files are found by them.

File format under the store's path:
  blocks/kind=0   key (16-byte digest), n (ids), data (ids as little-endian unsigned integers, 2 bytes for a
                  vocabulary under 65,536, else 4)
  blocks/kind=1   unordered recipes: doc_id, n, key (Merkle root), data (chunk digests, concatenated)
  recipes         the same recipes in ascending doc_id order, with part, rid and local_start
  manifest        per part: first and last doc_id, documents, ids, Merkle root
  manifest_root   one row: Merkle root over the parts

Edge cases: a null text counts as empty, and an empty text is the end id alone; a null doc_id sorts first; rows with
the same doc_id are separate documents, ordered by their Merkle root; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType

from skyloom.llm.common import bounded_batches, narrow, scratch_path

DIGEST = 16
WINDOW, MIN_IDS, MAX_IDS, CUT_BITS = 8, 256, 4096, 10
#: Distinct pieces of either table whose ids a worker remembers (some 20 and 45 MB); a full table starts anew.
PIECES = 400_000
#: Bytes of text that are encoded at once.
SLICE_BYTES = 1 << 19
CRC_POLY = np.uint64(0xEDB88320)

#: Classes of bytes. OTHER is whatever is not known to be one of the rest; nothing is cut beside it.
OTHER, LETTER, MARK, BLANK, LINE, QUOTE, DIGIT = range(7)


def _classes() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for c in map(chr, range(33, 127)):
        out[ord(c)] = LETTER if c.isalpha() else DIGIT if c.isdigit() else QUOTE if c == "'" else MARK
    out[32], out[10] = BLANK, LINE
    return out


def _cuts() -> np.ndarray:
    """Whether a text may be cut between a byte of one class and a byte of another: always where both neighbours belong
    to different tokens of the byte-level pattern, whatever stands around them."""
    out = np.zeros((7, 7), bool)
    words = (LETTER, MARK, QUOTE, DIGIT)
    out[words, BLANK] = out[words, LINE] = True  # white space never joins what it follows
    out[LETTER, (MARK, QUOTE, DIGIT)] = out[DIGIT, (LETTER, MARK, QUOTE)] = True
    out[MARK, (LETTER, DIGIT)] = True  # a quote before letters may be a contraction, so no cut there
    return out.reshape(-1)


CLASSES, CUTS, WORDY = _classes(), _cuts(), np.isin(np.arange(7), (LETTER, MARK, QUOTE, DIGIT))
#: What is left of a 64-bit word that begins with so many bytes of a piece.
KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_MIXERS = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]

#: The characters that a byte-level vocabulary writes bytes as: printable ones themselves, the others from U+0100 on. The
#: line break stays, as it separates words.
_PRINTED = np.isin(np.arange(256), [*range(33, 127), *range(161, 173), *range(174, 256)])
STAND_FOR = np.where(_PRINTED, np.arange(256), 255 + np.cumsum(~_PRINTED)).astype("<u4")
STAND_FOR[10] = 10

_encoders: dict = {}


def pieces_of(blob: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Beginnings of the pieces of the texts that begin at `starts` in blob (bytes of UTF-8), and whether a piece is a
    single token of the byte-level pattern: letters, with or without a blank before them."""
    c = CLASSES[blob]
    high = np.flatnonzero(blob >= 0x80)
    if len(high):  # U+00C0 to U+017F are letters but for the signs of multiplication and division
        lead = (blob[high] >= 0xC3) & (blob[high] <= 0xC5)
        at = high[lead]
        after = blob[np.minimum(at + 1, len(blob) - 1)]
        at = at[~((blob[at] == 0xC3) & ((after == 0x97) | (after == 0xB7)))]
        c[at] = c[np.minimum(at + 1, len(blob) - 1)] = LETTER
    cut = np.zeros(len(blob), bool)
    cut[1:] = CUTS[c[:-1] * np.uint8(7) + c[1:]]
    # a single line break between two words is a token of its own
    cut[2:] |= (c[1:-1] == LINE) & WORDY[c[2:]] & WORDY[c[:-2]]
    cut[starts[starts < len(blob)]] = True
    begin = np.flatnonzero(cut)
    odd = np.concatenate([[0], np.cumsum(c != LETTER)])
    end = np.append(begin[1:], len(blob))
    word = (odd[end] == odd[begin + 1]) & ((c[begin] == LETTER) | (c[begin] == BLANK) & (end > begin + 1))
    return begin, word


class Table:
    """Pieces of up to 8 * words bytes by their bytes, with where their ids are: open addressing, worked on by columns."""

    def __init__(self, words: int, capacity: int = 0):
        self.words, self.capacity = words, capacity or PIECES
        self.bits = (2 * self.capacity - 1).bit_length()
        self.clear()

    def clear(self) -> None:
        self.size, self.used = 0, 0
        self.table = np.full(1 << self.bits, -1, np.int32)
        self.keys = np.zeros((1024, self.words), np.uint64)
        self.at, self.n = np.zeros(1024, np.int32), np.zeros(1024, np.int32)
        self.ids = np.zeros(4096, np.uint32)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        h = keys[:, 0] * _MIXERS[0]
        for k in range(1, self.words):
            h = ((h ^ (h >> np.uint64(29))) + keys[:, k]) * _MIXERS[k]
        h ^= h >> np.uint64(32)
        return ((h * _MIXERS[1]) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 for unknown ones."""
        out, slot, todo = np.full(len(keys), -1, np.int32), self.slots(keys), np.arange(len(keys))
        while len(todo):
            k = self.table[slot]
            same = (k >= 0) & (self.keys[k] == keys[todo]).all(1)
            out[todo[same]] = k[same]
            go = (k >= 0) & ~same
            todo, slot = todo[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, keys: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> None:
        """Keys that are unknown and differ from each other, with their ids one after the other and how many each has."""
        base, new = self.size, self.size + len(keys)
        self.keys, self.at, self.n = (_grown(a, new) for a in (self.keys, self.at, self.n))
        self.ids = _grown(self.ids, self.used + len(flat))
        self.keys[base:new], self.n[base:new] = keys, sizes
        self.at[base:new] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : self.used + len(flat)] = flat
        self.size, self.used = new, self.used + len(flat)
        slot, todo = self.slots(keys), np.arange(base, new, dtype=np.int32)
        while len(todo):
            free = np.flatnonzero(self.table[slot] < 0)
            self.table[slot[free]] = todo[free]  # of several for one slot the last stays
            go = self.table[slot] != todo
            todo, slot = todo[go], (slot[go] + 1) & ((1 << self.bits) - 1)


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    if n <= len(a):
        return a
    out = np.zeros((max(n, 3 * len(a) // 2), *a.shape[1:]), a.dtype)
    out[: len(a)] = a
    return out


class PieceEncoder:
    """Encodes texts through the tokenizers library, remembering short pieces it has met.

    The ids of a text are those of its pieces, cut where the byte-level pattern always ends a token (see pieces_of).
    Pieces of up to 32 bytes are looked up by their bytes; unknown and longer ones go through the library. A text with a
    special token or a null character goes through it as a whole, and so do all texts if the file is not of this kind.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.lib = Tokenizer.from_file(path)
        kind = self.lib.pre_tokenizer
        self.byte_level = isinstance(kind, pre_tokenizers.ByteLevel) and kind.use_regex and not kind.add_prefix_space and self.lib.normalizer is None and isinstance(self.lib.model, models.BPE)
        if self.byte_level:
            # the same model for words alone, which come as the characters that stand for their bytes, one to a line
            self.by_line = Tokenizer.from_file(path)
            self.by_line.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
            self.bytes_of = np.zeros(max(self.lib.get_vocab().values()) + 1, np.int64)
            for token, i in self.lib.get_vocab().items():
                self.bytes_of[i] = len(token)
        self.kind = np.dtype("<u2") if self.lib.get_vocab_size() < 65536 else np.dtype("<u4")
        self.special = [t.content.encode() for t in self.lib.get_added_tokens_decoder().values()] + [b"\0"]
        self.tables = (Table(1), Table(4))

    def library(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has."""
        ids = [e.ids for e in self.lib.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for single tokens of the pattern, many at once: the lengths of tokens tell where a word ends."""
        lines = STAND_FOR[np.frombuffer(b"\n".join(words), np.uint8)].tobytes().decode("utf-32-le")
        ids = np.array(self.by_line.encode_batch_fast([lines], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))) + 1
        return ids, np.diff(ends, prepend=0)

    def encode(self, data: list[bytes]) -> list[np.ndarray]:
        """Ids of each text (UTF-8), with the end id 0."""
        whole = np.array([not self.byte_level or any(x in t for x in self.special) for t in data], bool)
        joined = b"".join(t for t, w in zip(data, whole) if not w)
        size = np.array([0 if w else len(t) for t, w in zip(data, whole)], np.int64)
        starts = np.cumsum(size) - size
        blob = np.frombuffer(joined + bytes(40), np.uint8)
        begin, word = pieces_of(blob[: len(joined)], starts[size > 0]) if joined else (np.zeros(0, np.int64), np.zeros(0, bool))
        length = np.diff(np.append(begin, len(joined)))
        at, n, pools, base = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64), [], 0
        for table, low in zip(self.tables, (0, 8)):
            mine = np.flatnonzero((length > low) & (length <= 8 * table.words))
            place = self.places(table, joined, blob, begin[mine], length[mine], word[mine])
            at[mine], n[mine] = base + table.at[place], table.n[place]
            pools.append(table.ids[: table.used])
            base += table.used
        rest = np.flatnonzero(length > 8 * self.tables[-1].words)
        extra = [*(joined[b : b + k] for b, k in zip(begin[rest].tolist(), length[rest].tolist())), *(t for t, w in zip(data, whole) if w)]
        others, sizes = self.library(extra)
        pools.append(others)
        first = np.cumsum(sizes) - sizes
        at[rest], n[rest] = base + first[: len(rest)], sizes[: len(rest)]
        # of each text, its ids and the end id
        pool = np.concatenate(pools)
        doc = np.searchsorted(starts + size, begin, "right") if len(begin) else begin
        total = np.bincount(doc, n, len(data)).astype(np.int64) + 1
        out = np.zeros(int(total.sum()), self.kind)
        before = np.cumsum(n) - n
        count = np.arange(int(n.sum())) - np.repeat(before, n)
        out[np.repeat(before + doc, n) + count] = pool[np.repeat(at, n) + count]
        ids = np.split(out, np.cumsum(total)[:-1])
        for i, a, k in zip(np.flatnonzero(whole).tolist(), first[len(rest) :].tolist(), sizes[len(rest) :].tolist()):
            ids[i] = np.append(others[a : a + k], 0).astype(self.kind)
        return ids

    def places(self, table: Table, joined: bytes, blob: np.ndarray, begin: np.ndarray, length: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Places of pieces in a table, which learns those it lacks."""
        words = np.ndarray(len(blob) - 7, np.uint64, blob, strides=(1,))  # the 8 bytes from each byte on
        keys = np.stack([words[begin + 8 * k] & KEEP[np.clip(length - 8 * k, 0, 8)] for k in range(table.words)], 1)
        if table.size + len(keys) > table.capacity:
            lacking = len(np.unique(keys[table.find(keys) < 0], axis=0))
            if table.size + lacking > table.capacity:
                table.clear()
        place = table.find(keys)
        new = np.flatnonzero(place < 0)
        if len(new):
            order = new[np.lexsort(keys[new].T)]
            first = order[np.concatenate([[True], (keys[order[1:]] != keys[order[:-1]]).any(1)])]
            for who, learn in ((first[word[first]], self.words), (first[~word[first]], self.library)):
                if len(who):
                    table.add(keys[who], *learn([joined[b : b + k] for b, k in zip(begin[who].tolist(), length[who].tolist())]))
            place[new] = table.find(keys[new])
        return place


def encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def gear(vocab: int) -> np.ndarray:
    """A pseudo-random 64-bit value for each id (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        z = (np.arange(1, vocab + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


GEAR = gear(1 << 16)


def cut_points(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one document: where the rolling hash of the last WINDOW ids has CUT_BITS zeros."""
    n = len(ids)
    if n <= MIN_IDS:
        return [n]
    g = GEAR[ids & 0xFFFF]
    h = g.copy()
    for k in range(1, WINDOW):
        h[k:] += g[:-k] << np.uint64(k)
    ends, start = [], 0
    for c in (np.flatnonzero((h >> np.uint64(64 - CUT_BITS)) == 0) + 1).tolist():
        while c - start > MAX_IDS:
            start += MAX_IDS
            ends.append(start)
        if c - start >= MIN_IDS:
            ends.append(start := c)
    while n - start > MAX_IDS:
        start += MAX_IDS
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of the binary hash tree; an odd node moves up unchanged."""
    level = [digest(b"\x00" + x) for x in leaves] or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\x01" + b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


class Merkle:
    """The root of merkle() over leaves that come one by one: one digest for each height is kept."""

    def __init__(self):
        self.stack: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        node = (0, digest(b"\x00" + leaf))
        while self.stack and self.stack[-1][0] == node[0]:
            node = (node[0] + 1, digest(b"\x01" + self.stack.pop()[1] + node[1]))
        self.stack.append(node)

    def root(self) -> bytes:
        if not self.stack:
            return digest(b"")
        out = self.stack[-1][1]
        for _, left in reversed(self.stack[:-1]):
            out = digest(b"\x01" + left + out)
        return out


def slices(texts: pa.Array):
    """(first row, texts as bytes) of about SLICE_BYTES at a time; null counts as empty."""
    rows, start, total = [], 0, 0
    for i, t in enumerate(texts.cast(pa.binary())):
        t = t.as_py() or b""
        rows.append(t)
        total += len(t)
        if total >= SLICE_BYTES:
            yield start, rows
            rows, start, total = [], i + 1, 0
    if rows:
        yield start, rows


BLOCKS = "kind int, shard long, key binary, doc_id long, n int, data binary"
BLOCKS_ARROW = pa.schema([("kind", pa.int32()), ("shard", pa.int64()), ("key", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int32()), ("data", pa.binary())])


#: Keys of chunks that a task remembers so as not to send a chunk twice; owners of keys drop what is left.
SEEN = 200_000


def _blocks(tokenizer: str):
    def run(batches):
        enc, seen = encoder(tokenizer), set()
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for a, texts in slices(batch.column(1)):
                rows = []
                for doc_id, ids in zip(doc_ids[a : a + len(texts)], enc.encode(texts)):
                    keys, start = [], 0
                    for end in cut_points(ids):
                        data = ids[start:end].tobytes()
                        keys.append(key := digest(data))
                        if key not in seen:
                            if len(seen) >= SEEN:
                                seen.clear()
                            seen.add(key)
                            rows.append((0, int.from_bytes(key[:8], "little", signed=True), key, None, end - start, data))
                        start = end
                    root = merkle(keys)
                    shard = int.from_bytes(digest(root + str(doc_id).encode())[:8], "little", signed=True)
                    rows.append((1, shard, root, doc_id, len(ids), b"".join(keys)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), BLOCKS_ARROW)], schema=BLOCKS_ARROW)

    return run


def _once(batches):
    """Of the chunks with one key, which reach the same task next to each other, the first."""
    last = None
    for batch in batches:
        keep = []
        for kind, key in zip(batch.column("kind").to_pylist(), batch.column("key").to_pylist()):
            keep.append(kind == 1 or key != last)
            last = key if kind == 0 else None
        yield batch.filter(pa.array(keep, pa.bool_()))


RECIPES = "part int, rid long, doc_id long, n int, local_start long, key binary, data binary"
RECIPES_ARROW = pa.schema([("part", pa.int32()), ("rid", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32()), ("local_start", pa.int64()), ("key", pa.binary()), ("data", pa.binary())])


def _ordered(batches):
    """Number the recipes of a part and sum their ids; rows arrive in doc_id order."""
    from pyspark import TaskContext

    part, at, total = TaskContext.get().partitionId(), 0, 0
    for b in batches:
        n = np.array(b.column("n").to_pylist(), np.int64)
        starts = total + np.cumsum(n) - n
        rid = (part << 40) + at + np.arange(len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), pa.array(rid), b.column("doc_id"), b.column("n"), pa.array(starts), b.column("key"), b.column("data")], schema=RECIPES_ARROW)
        at, total = at + len(n), total + int(n.sum())


def write_store(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Encode all docs(doc_id, text) into a store at path."""
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = narrow(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_blocks(tokenizer), BLOCKS)
    blocks.repartition(parts, "shard").sortWithinPartitions("kind", "shard", "key").mapInArrow(_once, BLOCKS).write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/blocks")
    recipes = read_blocks(spark, path, 1).select("doc_id", "n", "key", "data")
    ordered = recipes.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.col("key")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "key")
    ordered.mapInArrow(_ordered, RECIPES).write.option("compression", "zstd").parquet(f"{path}/recipes")
    manifest_of(read_recipes(spark, path), parts).write.parquet(f"{path}/manifest")
    spark.createDataFrame([(bytearray(root_of(read_manifest(spark, path))),)], "root binary").coalesce(1).write.parquet(f"{path}/manifest_root")


MANIFEST = "part int, first_doc long, last_doc long, docs long, ids long, root binary"
MANIFEST_ARROW = pa.schema([("part", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64()), ("root", pa.binary())])


def manifest_of(recipes: DataFrame, parts: int) -> DataFrame:
    """A row for each part: what its recipes amount to. Recipes stream by; a task keeps one digest for each tree level."""
    return recipes.select("part", "rid", "doc_id", "n", "key").repartition(parts, "part").sortWithinPartitions("part", "rid").mapInArrow(_part_rows, MANIFEST)


def _part_rows(batches):
    rows, tree, part = [], None, None
    for b in batches:
        for p, doc_id, n, key in zip(*(b.column(c).to_pylist() for c in ("part", "doc_id", "n", "key"))):
            if p != part:
                if tree:
                    rows[-1][5] = tree.root()
                rows.append([p, doc_id, doc_id, 0, 0, None])
                part, tree = p, Merkle()
            rows[-1][2], rows[-1][3], rows[-1][4] = doc_id, rows[-1][3] + 1, rows[-1][4] + n
            tree.add(key)
    if tree:
        rows[-1][5] = tree.root()
    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows) if rows else [()] * 6, MANIFEST_ARROW)], schema=MANIFEST_ARROW)


def read_manifest(spark, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def root_of(manifest: DataFrame) -> bytes:
    rows = manifest.select("part", "root").orderBy("part").collect()  # a row for each part file
    return merkle([bytes(r.root) for r in rows])


def verify_manifest(spark, path: str) -> None:
    """Raise ValueError unless the recipes are those that the manifest and its root were made of."""
    manifest = read_manifest(spark, path)
    roots = [bytes(r.root) for r in spark.read.schema("root binary").parquet(f"{path}/manifest_root").collect()]
    if roots != [root_of(manifest)]:
        raise ValueError("the manifest does not match its root")
    found = manifest_of(read_recipes(spark, path), int(spark.conf.get("spark.sql.shuffle.partitions")))
    if not found.exceptAll(manifest).isEmpty() or found.count() != manifest.count():
        raise ValueError("the recipes do not match the manifest")


def read_blocks(spark, path: str, kind: int) -> DataFrame:
    return spark.read.schema("shard long, key binary, doc_id long, n int, data binary, kind int").parquet(f"{path}/blocks").where(F.col("kind") == kind)


def read_recipes(spark, path: str) -> DataFrame:
    return spark.read.schema(RECIPES).parquet(f"{path}/recipes")


def _checked_chunks(width: int):
    def run(batches):
        schema = pa.schema([("key", pa.binary()), ("m", pa.int32()), ("crc", pa.int64())])
        for b in batches:
            crcs = []
            for key, n, data in zip(b.column("key").to_pylist(), b.column("n").to_pylist(), b.column("data").to_pylist()):
                if digest(data) != key or len(data) != n * width:
                    raise ValueError(f"chunk {key.hex()} is damaged")
                crcs.append(zlib.crc32(np.frombuffer(data, f"<u{width}").astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("n"), pa.array(crcs, pa.int64())], schema=schema)

    return run


def gf2_times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of polynomials over GF(2) modulo the crc32 polynomial, bits reversed as crc32 has them."""
    a, b = np.broadcast_arrays(a, b)
    out, b = np.zeros(a.shape, np.uint64), b.copy()
    for bit in range(31, -1, -1):
        out ^= np.where((a >> np.uint64(bit)) & np.uint64(1), b, np.uint64(0))
        b = (b >> np.uint64(1)) ^ np.where(b & np.uint64(1), CRC_POLY, np.uint64(0))
    return out


def _squares() -> list[np.ndarray]:
    out = [np.array([1 << 30], np.uint64)]
    for _ in range(63):
        out.append(gf2_times(out[-1], out[-1]))
    return out


SQUARES = _squares()


def crc_shift(size: np.ndarray) -> np.ndarray:
    """What a crc32 is multiplied by when so many bytes follow."""
    out = np.full(len(size), 1 << 31, np.uint64)
    for k in range(int(size.max(initial=0)).bit_length()):
        out = np.where((size >> np.uint64(k)) & np.uint64(1), gf2_times(SQUARES[k + 3], out), out)
    return out


#: The same for all numbers of ids that a chunk can have.
SHIFTS = crc_shift(4 * np.arange(MAX_IDS + 1, dtype=np.uint64))


def crc_join(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of two byte strings in a row, from their own crc32s and the second's length."""
    known = not (size % np.uint64(4)).any() and size.max(initial=0) <= 4 * MAX_IDS
    shift = SHIFTS[size // np.uint64(4)] if known else crc_shift(size)
    return gf2_times(shift, first) ^ second


@F.pandas_udf(LongType())
def _document_crc(crcs: pd.Series, sizes: pd.Series) -> pd.Series:
    """Per document its chunks' crc32s and numbers of ids, in order."""
    lengths = crcs.map(len).to_numpy()
    crc = crcs.map(lambda c: c[0]).to_numpy().astype(np.uint64)
    for k in range(1, lengths.max(initial=0)):
        who = np.flatnonzero(lengths > k)
        crc[who] = crc_join(crc[who], crcs.iloc[who].map(lambda c: c[k]).to_numpy().astype(np.uint64), 4 * sizes.iloc[who].map(lambda c: c[k]).to_numpy().astype(np.uint64))
    return pd.Series(crc.astype(np.int64))


@F.pandas_udf(BooleanType())
def _root_holds(key: pd.Series, data: pd.Series) -> pd.Series:
    out = [merkle([d[i : i + DIGEST] for i in range(0, len(d), DIGEST)]) == k for k, d in zip(key, data)]
    if not all(out):
        raise ValueError("a recipe does not match its Merkle root")
    return pd.Series(out, dtype=bool)


def read_digests(spark, path: str, width: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, chunks, root: from the files alone.

    The manifest and its root are checked against the recipes first; each recipe's root, each chunk's digest, and that a
    document has all its chunks and ids are checked as the rows are read. Damage raises an error.
    """
    verify_manifest(spark, path)
    recipes = read_recipes(spark, path)
    offsets = recipes.groupBy("part").agg(F.sum("n").alias("total"))
    offsets = _offsets(offsets)
    chunks = read_blocks(spark, path, 0).select("key", "n", "data").mapInArrow(_checked_chunks(width), "key binary, m int, crc long")
    entries = recipes.where(_root_holds("key", "data")).select("rid", F.posexplode(F.expr(f"transform(sequence(0, int(length(data) / {DIGEST}) - 1), i -> substring(data, i * {DIGEST} + 1, {DIGEST}))")).alias("pos", "key"))
    crcs = entries.join(chunks, "key").groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("pos", "crc", "m"))).alias("parts")).select("rid", _document_crc("parts.crc", "parts.m").alias("ids_crc32"), F.size("parts").alias("chunks"), F.expr("aggregate(parts.m, 0L, (a, m) -> a + m)").alias("ids"))
    whole = F.coalesce((F.col("chunks") == F.length("data") / DIGEST) & (F.col("ids") == F.col("n")), F.lit(False))
    return (
        recipes.join(F.broadcast(offsets), "part").join(crcs, "rid", "left")
        .select("doc_id", (F.col("offset") + F.col("local_start")).alias("start"), F.col("n").cast("long").alias("n_tokens"), F.when(whole, F.col("ids_crc32")).otherwise(F.raise_error(F.lit("chunks of a document are missing"))).alias("ids_crc32"), "chunks", F.hex("key").alias("root"))
    )


def _offsets(totals: DataFrame) -> DataFrame:
    """Ids before each part; there is a row for each part file, so one task can sum them."""
    from pyspark.sql import Window

    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(w), F.lit(0)).alias("offset"))


def read_ids(spark, path: str, width: int = 2) -> DataFrame:
    """doc_id and its ids, rebuilt from the store."""
    recipes = read_recipes(spark, path)
    entries = recipes.select("rid", "doc_id", F.posexplode(F.expr(f"transform(sequence(0, int(length(data) / {DIGEST}) - 1), i -> substring(data, i * {DIGEST} + 1, {DIGEST}))")).alias("pos", "key"))
    chunks = read_blocks(spark, path, 0).select("key", F.col("data").alias("chunk"))

    @F.pandas_udf("array<int>")
    def ids(parts: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(b"".join(r["chunk"] for r in sorted(p, key=lambda r: r["pos"])), f"<u{width}").astype(np.int32) for p in parts])

    return entries.join(chunks, "key").groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.collect_list(F.struct("pos", "chunk")).alias("parts")).select("doc_id", ids("parts").alias("ids"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_digests(docs: DataFrame, tokenizer: str | None = None, path: str | None = None) -> DataFrame:
    """Write docs to a store, then return what its files say of each document."""
    tokenizer = tokenizer or default_tokenizer()
    path = path or scratch_path(docs.sparkSession, "token-store")
    write_store(docs, path, tokenizer)
    return read_digests(docs.sparkSession, path, encoder(tokenizer).kind.itemsize)
