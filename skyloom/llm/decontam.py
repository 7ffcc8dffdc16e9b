"""Operator 10: benchmark decontamination by BM25 and block-max WAND.

Verification. The question of a test item is all sentences but its last, the answer the last. A passage of a training
text is a leak of the item by the shares of the five-word shingles of either part that it holds (OVERLAP: reached):
- question and answer both reach OVERLAP: the item is there as a whole;
- the question reaches it and has QUESTION words or more: a leak whatever became of the answer (left out or altered);
- the answer and the item as a whole reach it: an item that is nearly all answer.
A short question alone, or an answer alone in an item that is not mostly answer, can be ordinary text and is no leak.

Retrieval. What is looked up are entries: each item as a whole, and each question that can be a leak by itself. They are
the documents of an inverted index: a posting holds an entry and the term's BM25 impact, divided by the least score of a
passage that the rule above can verify (need), so that one threshold, 1, serves all entries and no leak is lost before
verification. Postings are kept in blocks with their largest impact. All training texts are cut into overlapping
passages of at least twice the longest item, so that an item that occurs lies within one passage; each passage is a
query. A passage whose terms' largest impacts cannot reach the threshold is passed over (one vectorised sum for a whole
batch); for the others WAND skips by term bounds and block bounds, and yields every entry at or above the threshold. The
score reported is the item's as a whole, as a share of its own score.

An index is built from about SHARD_BYTES of items; a larger benchmark is several indexes, each with a scan of the texts.
How many items there are, in how many of them a word occurs and how long they are on average is counted once over all
items, so scores do not depend on the number of indexes. An index travels to the tasks once (Spark broadcasts functions
that are large); its size follows SHARD_BYTES.

Edge cases: null and empty texts have no passages; items without words are never found; an item with a null id is
searched for like all others and reported with a null item_id; parts under five words count as one shingle; rows that
repeat are reported each; empty tables give an empty result; extra columns, whatever their names, are carried along
untouched by without_contaminated and ignored otherwise.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import bounded_batches, narrow, written
from skyloom.llm.shingles import SHINGLE, plain, word_hashes

K1, B = 1.2, 0.75
OVERLAP = 0.8
#: Words of a question that is a leak without its answer.
QUESTION = 8
BLOCK = 16
PASSAGE = 128
#: Ranges of entries with a bound of their own in the test that passes over hopeless passages.
RANGES = 64
#: Bytes of items in an index, on average.
SHARD_BYTES = 2 << 20
SLICE_BYTES = 1 << 18
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def parts_of(text: str) -> tuple[bytes, bytes]:
    """Question and answer: all sentences but the last, and the last; a single sentence is both."""
    s = [x for x in SENTENCE.split(text) if plain(x).split()]
    if len(s) < 2:
        return plain(text), plain(text)
    return plain(" ".join(s[:-1])), plain(s[-1])


def shingle_set(words: list[bytes]) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


def share(part: list[bytes], passage: list[bytes], have: set) -> float:
    """Share of the part's shingles that the passage has; a part under SHINGLE words must occur as it is."""
    if len(part) < SHINGLE:
        n = len(part)
        return float(any(passage[i : i + n] == part for i in range(len(passage) - n + 1)))
    own = shingle_set(part)
    return len(own & have) / len(own)


def leaked(whole: float, question: float, answer: float, words: int) -> bool:
    """Whether the shares of an item and its parts make a leak; words: length of the question."""
    if question >= OVERLAP:
        return answer >= OVERLAP or words >= QUESTION
    return answer >= OVERLAP and whole >= OVERLAP


def absent(part: list[bytes], impact: dict[bytes, float]) -> float:
    """Upper bound of the impact of the terms that a passage lacks which has OVERLAP of the part's shingles.

    Each lacking word takes all shingles it is in along, so not more words than shingles are lacking; at most two words
    a shingle (its first and its last) where shingles repeat.
    """
    if len(part) < SHINGLE:
        return 0.0
    n = len(shingle_set(part))
    lacking = int(n * (1 - OVERLAP) + 1e-9) * (1 if n == len(part) - SHINGLE + 1 else 2)
    return sum(sorted((impact[w] for w in set(part)), reverse=True)[:lacking])


class Index:
    """BM25 postings of test items in blocks, by word hash."""

    def __init__(self, items: list[tuple[int | None, str]], statistics: tuple[int, float, dict[bytes, int]] | None = None):
        """items: (item_id, text); statistics: number of items with words, their mean length, and for each word of these
        items the number of items it is in; by default those of the items themselves."""
        self.items = []
        for item_id, text in sorted(((i, t or "") for i, t in items), key=lambda x: (x[0] is None, x[0] or 0, x[1])):
            words = plain(text).split()
            if words:
                self.items.append((item_id, words, *[p.split() for p in parts_of(text)]))
        tf = [Counter(w) for _, w, *_ in self.items]
        n, mean, df = statistics or (len(tf), sum(len(w) for _, w, *_ in self.items) / max(1, len(tf)), Counter(w for c in tf for w in c))
        names = sorted({w for c in tf for w in c})
        idf = {w: np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) for w in names}
        postings: dict[bytes, list[tuple[int, float]]] = {w: [] for w in names}
        self.entries: list[int] = []  # item of each entry
        self.whole: list[tuple[int, float]] = []  # entry of each item as a whole, and what its impacts are divided by, as a share of its own score
        for i, c in enumerate(tf):
            _, words, question, answer = self.items[i]
            size = sum(c.values())
            impact = {w: idf[w] * f * (K1 + 1) / (f + K1 * (1 - B + B * size / mean)) for w, f in c.items()}
            lack = max(absent(words, impact), absent(question, impact) + absent(answer, impact))
            parts = [(list(c), lack)]
            if question != words and len(question) >= QUESTION:
                parts.append((sorted(set(question)), absent(question, impact)))
            for k, (terms, lack) in enumerate(parts):
                own = sum(impact[w] for w in terms)
                need = max(own - lack, min(impact[w] for w in terms)) - 1e-6 * own
                if k == 0:
                    self.whole.append((len(self.entries), need / own))
                for w in terms:
                    postings[w].append((len(self.entries), impact[w] / need))
                self.entries.append(i)
        hashes = word_hashes([b" ".join(names)])[1] if names else np.zeros(0, np.uint64)
        order = np.argsort(hashes)
        self.vocabulary = hashes[order]
        self.ids = [[i for i, _ in postings[names[k]]] for k in order]
        self.impacts = [[x for _, x in postings[names[k]]] for k in order]
        self.blocks = [[max(p[a : a + BLOCK]) for a in range(0, len(p), BLOCK)] for p in self.impacts]
        self.bound = np.array([max(p) for p in self.impacts] or [], np.float64)
        size = len(self.entries)
        width = max(1, -(-size // RANGES))
        self.ranged = np.zeros((len(self.ids) + 1, -(-size // width) if size else 1), np.float32)  # a term's largest impact in each range
        for t, (ids, impacts) in enumerate(zip(self.ids, self.impacts)):
            np.maximum.at(self.ranged[t], np.array(ids) // width, np.array(impacts, np.float32))
        longest = max((len(w) for _, w, *_ in self.items), default=1)
        self.passage = max(PASSAGE, 2 * longest)

    def terms(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each word in the vocabulary, -1 for words of no item."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def wand(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """Every (entry, score) at or above threshold for a query of distinct terms."""
        cursors = [[self.ids[t][0], t, 0] for t in terms]
        heapq.heapify(cursors)
        found = []
        bound, eps = self.bound, 1e-9
        while cursors:
            cursors.sort()
            total, pivot = 0.0, -1
            for k, (_, t, _) in enumerate(cursors):
                total += bound[t]
                if total >= threshold - eps:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            head = cursors[: pivot + 1]
            # block bounds of the blocks that hold the pivot item
            limit, edge = 0.0, None
            for c in head:
                ids, p = self.ids[c[1]], c[2]
                b = p // BLOCK
                while (b + 1) * BLOCK <= len(ids) and ids[min(len(ids), (b + 1) * BLOCK) - 1] < item:
                    b += 1
                limit += self.blocks[c[1]][b] if b * BLOCK < len(ids) else 0.0
                last = ids[min(len(ids), (b + 1) * BLOCK) - 1]
                edge = last if edge is None else min(edge, last)
            if limit >= threshold - eps:
                if head[0][0] == item:
                    score = sum(self.impacts[c[1]][c[2]] for c in head)
                    if score >= threshold - eps:
                        found.append((item, score))
                    goal = item + 1
                else:
                    goal = item
            else:
                goal = max(item, edge) + 1
                if pivot + 1 < len(cursors):
                    goal = min(goal, max(item + 1, cursors[pivot + 1][0]))
            moved = []
            for c in head:
                ids, p = self.ids[c[1]], c[2]
                while p < len(ids) and ids[p] < goal:
                    p += 1
                if p < len(ids):
                    moved.append([ids[p], c[1], p])
            cursors = moved + cursors[pivot + 1 :]
        return found

    def score(self, item: int, terms: list[int]) -> float:
        """Share of the item's own score that a query of distinct terms reaches."""
        entry, need = self.whole[item]
        total = 0.0
        for t in terms:
            ids = self.ids[t]
            p = bisect_left(ids, entry)
            if p < len(ids) and ids[p] == entry:
                total += self.impacts[t][p]
        return total * need

    def leaks(self, texts: list[str | None]):
        """(text index, item, score, question share, answer share, first word) of all verified passages, best first."""
        data = [plain(t) for t in texts]
        doc, hashes = word_hashes(data)
        term = self.terms(hashes)
        n = np.bincount(doc, minlength=len(data))
        offset = np.cumsum(n) - n
        step = self.passage // 2
        # passages: word w of a text is in those that start at w // step and one step before
        count = np.maximum(1, -(-(n - step) // step)) * (n > 0)
        base = np.cumsum(count) - count
        known = np.flatnonzero(term >= 0)
        d, place = doc[known], known - offset[doc[known]]
        late = np.minimum(place // step, count[d] - 1)
        early = place // step - 1
        key = np.concatenate([base[d] + late, (base[d] + early)[early >= 0]]) * len(self.ranged) + np.concatenate([term[known], term[known][early >= 0]])
        key = np.unique(key)
        passage, own = key // len(self.ranged), key % len(self.ranged)
        cut = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]])) if len(key) else np.zeros(0, np.int64)
        if not len(cut):
            return
        limit = np.concatenate([np.add.reduceat(self.ranged[own[a:b]], cut_ - a, axis=0).max(1) for a, b, cut_ in _pieces(cut, len(own))])
        hot = np.flatnonzero(limit >= 1 - 1e-4)
        ends = np.append(cut, len(own))
        of = np.repeat(np.arange(len(data)), count)
        todo: dict[int, list] = {}
        for h in hot.tolist():
            g = int(passage[cut[h]])
            todo.setdefault(int(of[g]), []).append(((g - int(base[of[g]])) * step, own[ends[h] : ends[h + 1]].tolist()))
        for i, some in todo.items():
            best: dict[int, tuple] = {}
            words = data[i].split()
            for start, query in some:
                passage = words[start : start + self.passage]
                have = None
                for item in sorted({self.entries[e] for e, _ in self.wand(query, 1.0)}):
                    have = have or shingle_set(passage)
                    _, whole, question, answer = self.items[item]
                    q, a = share(question, passage, have), share(answer, passage, have)
                    if leaked(share(whole, passage, have), q, a, len(question)):
                        row = (self.score(item, query), q, a, start)
                        best[item] = max(best.get(item, row), row)
            for item, row in sorted(best.items()):
                yield i, self.items[item][0], *row


def _pieces(cut: np.ndarray, n: int):
    """Runs of whole passages of about 2 ** 16 entries: (first entry, last, starts of passages)."""
    ends = np.append(cut, n)
    a = 0
    while a < len(cut):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + (1 << 16), "right")) - 1)
        yield int(ends[a]), int(ends[b]), cut[a:b]
        a = b


def _terms(batches):
    """(lot, length of the item, word) for each word of an item once, and a row without a word for each item."""
    schema = pa.schema([("lot", pa.int32()), ("length", pa.int64()), ("word", pa.binary())])
    for b in batches:
        rows = []
        for lot, text in zip(b.column("lot").to_pylist(), b.column("text").to_pylist()):
            if words := plain(text).split():
                rows.append((lot, len(words), None))
                rows += [(lot, None, w) for w in sorted(set(words))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def indexes(benchmark: DataFrame, shard_bytes: int = SHARD_BYTES):
    """Indexes over the benchmark: about `shard_bytes` of items at a time reach the driver, with the counts of their words."""
    items = narrow(benchmark, "item_id", "text").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // shard_bytes))
    items = items.withColumn("lot", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("int"))
    if n == 1:
        yield Index([(r.item_id, r.text) for r in items.collect()])  # at most shard_bytes
        return
    items = written(items, "leak-items")
    terms = written(items.mapInArrow(_terms, "lot int, length long, word binary"), "leak-terms")
    count, mean = terms.where("word is null").agg(F.count("*"), F.avg("length")).first()
    df = written(terms.where("word is not null").groupBy("word").agg(F.count("*").alias("n")), "leak-words")
    for k in range(n):
        own = df.join(terms.where((F.col("lot") == k) & F.col("word").isNotNull()).select("word").distinct(), "word")
        words = {bytes(r.word): r.n for r in own.collect()}
        yield Index([(r.item_id, r.text) for r in items.where(F.col("lot") == k).collect()], (count, mean, words))


def _ranges(texts):
    a = 0
    while a < len(texts):
        e, size = a, 0
        while e < len(texts) and (e == a or size + len(texts[e] or "") < SLICE_BYTES):
            size += len(texts[e] or "")
            e += 1
        yield a, e
        a = e


LEAKS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()), ("first_word", pa.int64())])


def contaminated(docs: DataFrame, benchmark: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap, first_word: the verified leaks of docs(doc_id, text)."""
    bounded_batches(docs.sparkSession)
    slim = narrow(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for index in indexes(benchmark, shard_bytes):

        def scan(batches, index=index):
            for b in batches:
                ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
                for a, e in _ranges(texts):
                    rows = [(ids[a + i], *row) for i, *row in index.leaks(texts[a:e])]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), LEAKS)], schema=LEAKS)

        part = slim.mapInArrow(scan, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long")
        out = part if out is None else out.union(part)
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The rows of docs without a verified leak, with all their columns."""
    bounded_batches(docs.sparkSession)
    at, schema = [c.lower() for c in docs.columns].index("text"), docs.schema
    for index in indexes(benchmark, shard_bytes):

        def keep(batches, index=index):
            for b in batches:
                texts = b.column(at).cast(pa.string()).to_pylist()
                bad = np.zeros(len(texts), bool)
                for a, e in _ranges(texts):
                    for i, *_ in index.leaks(texts[a:e]):
                        bad[a + i] = True
                yield b.filter(pa.array(~bad))

        docs = docs.mapInArrow(keep, schema)
    return docs


def _sql() -> str:
    """The rule applied to every passage and every item, without any retrieval."""
    words = lambda x: rf"list_filter(string_split(regexp_replace(lower({x}), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]', ' ', 'g'), ' '), lambda y: y <> '')"
    grams = lambda w, n: f"list_transform(range(1, len({w}) - {n} + 2), lambda j: array_to_string({w}[j:j + {n} - 1], ' '))"
    return rf"""
WITH t AS (SELECT row_number() OVER () AS i, item_id, coalesce(text, '') AS text FROM benchmark),
s AS (SELECT *, list_filter(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda x: len({words('x')}) > 0) AS s FROM t),
p AS (SELECT i, item_id, {words('text')} AS whole, CASE WHEN len(s) < 2 THEN {words('text')} ELSE {words("array_to_string(s[1:len(s) - 1], ' ')")} END AS q, CASE WHEN len(s) < 2 THEN {words('text')} ELSE {words('s[len(s)]')} END AS a FROM s),
k AS (SELECT i, 'w' AS kind, whole AS w FROM p UNION ALL SELECT i, 'q', q FROM p UNION ALL SELECT i, 'a', a FROM p),
g AS (SELECT DISTINCT i, kind, least(len(w), {SHINGLE}) AS n, unnest(CASE WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')] ELSE {grams('w', SHINGLE)} END) AS gram FROM k WHERE len(w) > 0),
o AS (SELECT i, kind, count(*) AS own FROM g GROUP BY i, kind),
z AS (SELECT greatest({PASSAGE}, 2 * max(len(whole))) AS size FROM p),
d AS (SELECT row_number() OVER () AS r, doc_id, {words("coalesce(text, '')")} AS w FROM documents),
f AS (SELECT r, w, size, unnest(range(greatest(1, ceil((len(w) - size // 2) / (size // 2)))::INT)) * (size // 2) AS start FROM d, z WHERE len(w) > 0),
v AS (SELECT r, start, w[start + 1:start + size] AS w FROM f),
h AS (SELECT DISTINCT r, start, n, unnest(list_transform(range(1, len(w) - n + 2), lambda j: array_to_string(w[j:j + n - 1], ' '))) AS gram FROM v, (SELECT DISTINCT n FROM g)),
m AS (SELECT r, start, i, kind, count(*) AS hit FROM h JOIN g USING (n, gram) GROUP BY r, start, i, kind),
x AS (SELECT r, start, i, max(CASE kind WHEN 'w' THEN hit::DOUBLE / own ELSE 0 END) AS ws, max(CASE kind WHEN 'q' THEN hit::DOUBLE / own ELSE 0 END) AS qs, max(CASE kind WHEN 'a' THEN hit::DOUBLE / own ELSE 0 END) AS az FROM m JOIN o USING (i, kind) GROUP BY r, start, i)
SELECT DISTINCT ON (x.r, x.i) d.doc_id, p.item_id FROM x JOIN d USING (r) JOIN p USING (i)
WHERE CASE WHEN qs >= {OVERLAP}::DOUBLE THEN az >= {OVERLAP}::DOUBLE OR len(q) >= {QUESTION} ELSE az >= {OVERLAP}::DOUBLE AND ws >= {OVERLAP}::DOUBLE END
"""


ORACLE_SQL = _sql()
