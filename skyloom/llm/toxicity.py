"""Operator 9: toxicity by compression distance.

Two zstandard dictionaries of equal size are learned from labelled rows. The toxic one holds strings (words and beginnings
of words) that toxic texts hold more often than ordinary ones, ranked by log-odds, as many as are borne out by SPREAD of
the toxic texts and fit into SIZE bytes; the ordinary one holds the most frequent words of ordinary texts. A text is cut at
white space into windows of about WINDOW bytes that cover all of it, and each window is compressed without a dictionary,
with the ordinary and with the toxic one. The bytes saved, window by window, give a few sums, and a logistic curve fitted
on cross-fitted training rows calibrates these into a probability; its threshold is fixed by the contract.

At most SAMPLE labelled rows train, in hash order of doc_id; all rows are scored, whole. Case and the amount of white space
do not count; every other character does.

Edge cases: null and blank texts have no window and score as such; a null doc_id is never a training row and counts as
not held out; without labels of both kinds the score is the share of toxic labels (0 without labels); rows that repeat
are scored each; an empty table gives an empty result; extra columns, whatever their names, are carried along untouched by
without_toxic and ignored otherwise.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import bounded_batches, crc_mod, labelled_sample, narrow

WINDOW = 48
SAMPLE = 6000
#: Most bytes of a dictionary.
SIZE = 4096
#: Share of the toxic training texts that a string of the toxic dictionary is in, at least.
SPREAD = 0.025
#: Least log-odds of a string in toxic text, by occurrences and by texts.
ODDS, ODDS_OF_TEXTS = 2.0, 1.5
#: The shortest match that a compressor looks for; shorter strings with the blank before them save nothing.
MATCH = 6
FOLDS = 4
#: What a missed toxic text weighs in the fit of the curve, in false alarms; strength of its ridge.
MISSED, RIDGE = 1.5, 0.1
THRESHOLD = 0.3
#: Savings in bytes from which a window counts: against no dictionary, and against the ordinary one.
STEPS, OVER = (2, 3, 4, 6), (2, 4)
FEATURES = 2 * len(STEPS) + len(OVER) + 4
CUT = re.compile(rb"\S[\s\S]{0,%d}(?=\s|\Z)|\S{1,%d}" % (WINDOW - 2, WINDOW - 1))
LETTERS = re.compile(r"[^\W\d_]+")


def strings_of(word: str) -> set[str]:
    """A word with the blank after it, and its beginnings: those that make up a match with the blank before them."""
    out = {word + " "} if len(word.encode()) >= MATCH - 2 else set()
    out.update(word[:k] for k in range(4, min(len(word), 10) + 1) if len(word[:k].encode()) >= MATCH - 1)
    return out


class Counts:
    """What dictionaries are made of, for some texts of one label: how often words and strings of interest occur, and in how
    many texts."""

    def __init__(self):
        self.words, self.uses, self.texts, self.n, self.chars = Counter(), Counter(), Counter(), 0, 0

    def add(self, text: str, words: set[str], strings: dict[str, tuple[str, ...]]) -> None:
        found, own = Counter(LETTERS.findall(text.lower())), Counter()
        for w, c in found.items():
            if w in words:
                self.words[w] += c
            for x in strings.get(w, ()):
                own[x] += c
        self.uses.update(own)
        self.texts.update(own.keys())
        self.n, self.chars = self.n + 1, self.chars + len(text)

    def without(self, other: Counts) -> Counts:
        out = Counts()
        out.words, out.uses, out.texts = (a - b for a, b in ((self.words, other.words), (self.uses, other.uses), (self.texts, other.texts)))
        out.n, out.chars = self.n - other.n, self.chars - other.chars
        return out


def of_interest(texts: list[str], y: np.ndarray) -> tuple[set[str], dict[str, tuple[str, ...]]]:
    """Words that an ordinary dictionary may hold, and for each word its strings that a toxic one may hold, in any fold."""
    words, of_texts = Counter(), Counter()
    for t, k in zip(texts, y):
        found = LETTERS.findall(t.lower())
        if k:
            of_texts.update(set().union(*map(strings_of, set(found))))
        else:
            words.update(found)
    least = max(3, SPREAD * (1 - 1 / FOLDS) * (y == 1).sum() - 1)
    kept = {s for s, c in of_texts.items() if c >= least}
    strings = {}
    for t in texts:
        for w in set(LETTERS.findall(t.lower())):
            if w not in strings and (own := strings_of(w) & kept):
                strings[w] = tuple(sorted(own))
    return {w for w, _ in words.most_common(SIZE)}, strings


def learn_dictionaries(ordinary: Counts, toxic: Counts) -> tuple[bytes, bytes]:
    """Contents of the ordinary and the toxic dictionary."""
    ranked = []
    for s, c in toxic.texts.items():
        if c < max(3, SPREAD * toxic.n):
            continue
        odds = np.log((toxic.uses[s] + 0.1) / max(1, toxic.chars)) - np.log((ordinary.uses[s] + 1.0) / max(1, ordinary.chars))
        of_texts = np.log(c / max(1, toxic.n)) - np.log((ordinary.texts[s] + 0.5) / max(1, ordinary.n))
        if odds > ODDS and of_texts > ODDS_OF_TEXTS:
            ranked.append((c * odds, s))
    ranked.sort(key=lambda x: (-round(x[0], 6), abs(len(x[1]) - MATCH), x[1]))  # long ends of words match others
    chosen: list[str] = []
    room = SIZE
    for _, s in ranked:  # neither a longer form of a chosen string nor a beginning that is hardly more frequent
        size = len(s.strip().encode()) + 1
        if size < room and not any(s.startswith(c.strip()) or c.startswith(s) and toxic.uses[s] < 1.3 * toxic.uses[c] for c in chosen):
            chosen.append(s)
            room -= size
    own = "".join(" " + s.strip() for s in reversed(chosen)).encode() + b" "
    common = [w for w, _ in sorted(ordinary.words.items(), key=lambda x: (-x[1], x[0])) if not strings_of(w) & set(chosen)]
    base, size = [], 0
    for w in common:  # the most frequent ones stand last, as those of the toxic dictionary do
        if size >= len(own):
            break
        base.append(w)
        size += len(w.encode()) + 1
    return ("".join(" " + w for w in reversed(base)).encode() + b" ")[-len(own) :].rjust(len(own)), own


#: All dictionaries end with HEAD, which opens each window, as TAIL closes it: what a compressed block costs by itself
#: is then paid in any case, and matches are found up to a window's end.
HEAD, TAIL = b"~0123456789~ABCDEFGHIJKLMNOP~ ", b" ~0123456789~"
SETTINGS = zstandard.ZstdCompressionParameters(window_log=14, hash_log=14, chain_log=14, search_log=5, min_match=MATCH, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False)


class Windows:
    """What dictionaries save over the windows of texts."""

    def __init__(self, contents: tuple[bytes, bytes]):
        self.each = []
        for c in (b"  ", *contents):
            d = zstandard.ZstdCompressionDict(c + HEAD, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=SETTINGS)
            self.each.append(zstandard.ZstdCompressor(compression_params=SETTINGS, dict_data=d))

    def savings(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Bytes that the ordinary and the toxic dictionary save, window by window."""
        framed = [HEAD + w + TAIL for w in CUT.findall(" ".join(text.lower().split()).encode("utf-8", "replace"))]
        plain, ordinary, toxic = (np.fromiter((len(c.compress(w)) for w in framed), np.int64, len(framed)) for c in self.each)
        return plain - ordinary, plain - toxic

    def features(self, text: str) -> np.ndarray:
        ordinary, toxic = self.savings(text)
        n = len(toxic)
        if not n:
            return np.zeros(FEATURES)
        hit = np.array([(toxic >= k).sum() for k in STEPS])
        more = np.array([(toxic - ordinary >= k).sum() for k in OVER])
        sums = min(20, toxic.max()) / 10, np.clip(toxic, -2, 12).mean(), np.clip(ordinary, -2, 12).mean(), np.log1p(n) / 5
        return np.array([*np.log1p(hit), *np.log((hit + 0.2) / (n + 4)), *np.log((more + 0.2) / (n + 4)), *sums])


def fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and intercept by Newton's method."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w, reg, cost = np.zeros(a.shape[1]), np.diag([RIDGE] * x.shape[1] + [1e-6]), np.where(y == 1, MISSED, 1.0)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (cost * p * (1 - p))[:, None]).T @ a + reg, a.T @ (cost * (p - y)) + reg @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(rows: list[tuple[int, str, int]]):
    """(dictionaries, weights) from (doc_id, text, toxic) rows."""
    rows = sorted(rows)
    texts, y = [r[1] for r in rows], np.array([r[2] for r in rows], int)
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.0
        return (b" ", b"  "), np.array([0.0] * FEATURES + [np.log((share + 1e-6) / (1 - share + 1e-6))])
    fold = np.zeros(len(y), int)  # features of a fold come from dictionaries of the others; each has its share of both kinds
    counts = [[Counts() for _ in range(FOLDS)] for _ in (0, 1)]
    whole = [Counts(), Counts()]
    for k in (0, 1):
        own = np.flatnonzero(y == k)
        fold[own] = np.arange(len(own)) % FOLDS
    words, strings = of_interest(texts, y)
    for t, k, f in zip(texts, y, fold):
        counts[k][f].add(t, words, strings)
        whole[k].add(t, words, strings)
    x = np.zeros((len(y), FEATURES))
    for f in range(FOLDS):
        w = Windows(learn_dictionaries(*(whole[k].without(counts[k][f]) for k in (0, 1))))
        for i in np.flatnonzero(fold == f):
            x[i] = w.features(texts[i])
    return learn_dictionaries(*whole), fit_logistic(x, y)


def probability(w: Windows, weights: np.ndarray, text: str | None) -> float:
    return float(1 / (1 + np.exp(-np.clip(np.append(w.features(text or ""), 1) @ weights, -30, 30))))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    rows = labelled_sample(docs, labels, "toxic", lambda i: crc_mod(i, 4) != 2, sample)
    return fit([(r.doc_id, r.text, r.y) for r in rows.collect()])  # at most `sample` rows


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of docs(doc_id, text)."""
    bounded_batches(docs.sparkSession)
    contents, weights = train(docs, labels, sample)

    def score(batches):
        w, schema = Windows(contents), pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([probability(w, weights, t.as_py()) for t in b.column("text")], pa.float64())], schema=schema)

    scored = narrow(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that score under the threshold, with all their columns."""
    bounded_batches(docs.sparkSession)
    contents, weights = train(docs, labels, sample)
    at, schema = [c.lower() for c in docs.columns].index("text"), docs.schema

    def keep(batches):
        w = Windows(contents)  # once a task
        for b in batches:
            yield b.filter(pa.array([probability(w, weights, t.as_py()) < THRESHOLD for t in b.column(at).cast(pa.string())], pa.bool_()))

    return docs.mapInArrow(keep, schema)
