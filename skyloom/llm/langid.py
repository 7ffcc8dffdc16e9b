"""Operator 6: language by unigram pieces, all segmentations summed.

Each language has a probability for every piece of a fixed public vocabulary. A word (a run of letters, lower-cased,
with the vocabulary's word mark before it) has the probability of all its segmentations into pieces together, which a
forward recursion over its characters sums, in logarithms, so that no word is too long for it; a text's likelihood is the
product over its words. Piece probabilities are learned by expectation maximisation (forward and backward sums) from the
words of at most SAMPLE texts a language, in hash order of doc_id; all texts are scored, whole. A worker remembers the
values of words it has met, up to WORDS of them; words of more than LONG letters are summed in stretches, each time.

Edge cases: a text that is null or has no letters is `und` with score 0; without any training text every text is `und`;
a null doc_id never trains and counts as not held out; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.common import bounded_batches, crc_mod, narrow, uniform

SAMPLE = 300
ROUNDS = 2
WORDS = 400_000
#: Letters of a word that is worked on together with others and remembered; positions of a stretch of longer ones.
LONG, STRETCH = 64, 4096
FLOOR = 1e-7
MARK = "▁"
LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = 0


def load_pieces(path: str) -> list[str]:
    """Pieces of letters of a sentencepiece model, lower-cased and unique; the first stands for any other letter."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    seen = {}
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i).lower()
        body = p.removeprefix(MARK)
        if body.isalpha() or p == MARK:
            seen.setdefault(p)
    return ["", *seen]


class Pieces:
    """Finds pieces by a hash of their characters, for all places of many words at once."""

    BITS = 18
    STEP = np.uint64(0x9E3779B97F4A7C15)
    MIXERS = [np.uint64(m) for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]

    def __init__(self, pieces: list[str]):
        """pieces[0] stands for letters that are no piece."""
        self.longest = max(map(len, pieces[1:]), default=1)
        self.tables: list[tuple[np.uint64, np.ndarray]] = []
        self.hashes = np.zeros(len(pieces), np.uint64)
        with np.errstate(over="ignore"):
            for i, s in enumerate(pieces):
                for c in s:
                    self.hashes[i] = self.hashes[i] * self.STEP + np.uint64(ord(c))
            todo = np.arange(1, len(pieces))
            for m in self.MIXERS:  # a piece whose place is taken goes to the next table
                table = np.zeros(1 << self.BITS, np.int32)
                slot = self.slots(self.hashes[todo], m)
                first = np.unique(slot, return_index=True)[1]
                table[slot[first]] = todo[first]
                self.tables.append((m, table))
                todo = np.delete(todo, first)
                if not len(todo):
                    break
            if len(todo):
                raise ValueError("too many pieces for the tables")

    def slots(self, h: np.ndarray, m: np.uint64) -> np.ndarray:
        return (((h ^ (h >> np.uint64(29))) * m) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(h.shape, -1, np.int32)
        for m, table in self.tables:
            k = table[self.slots(h, m)]
            hit = (k > 0) & (self.hashes[k] == h)
            out[hit] = k[hit]
        return out


def lattice(words: list[str], pieces: Pieces) -> np.ndarray:
    """(words, longest word, longest piece) piece ids: of the piece that ends after position j and has length l + 1, else -1."""
    width = max(map(len, words))
    chars = np.array(words, f"U{width}").view(np.uint32).reshape(len(words), width).astype(np.uint64)
    out = np.full((len(words), width, pieces.longest), -1, np.int32)
    h = np.zeros_like(chars)
    for l in range(min(pieces.longest, width)):  # noqa: E741
        h[:, l:] = h[:, l - 1 : -1] * Pieces.STEP + chars[:, l:] if l else chars
        out[:, l:, l] = pieces.find(h[:, l:])
    single = out[:, :, 0]
    single[single < 0] = UNKNOWN
    return out


def forward(grid: np.ndarray, p: np.ndarray) -> np.ndarray:
    """(positions + 1, words, languages) logarithms of the sums over the segmentations of each beginning.

    p: (pieces, languages), logarithms."""
    n, width, longest = grid.shape
    alpha = np.full((width + 1, n, p.shape[1]), -np.inf)
    alpha[0] = 0
    for j in range(1, width + 1):
        for l in range(1, min(j, longest) + 1):  # noqa: E741
            ids = grid[:, j - 1, l - 1]
            who = np.flatnonzero(ids >= 0)
            if len(who):
                alpha[j, who] = np.logaddexp(alpha[j, who], alpha[j - l, who] + p[ids[who]])
    return alpha


def long_score(word: str, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """(languages) log probability of one word of any length: STRETCH positions at a time, after the beginnings that the
    longest piece reaches back to."""
    back = pieces.longest
    past = np.full((back, p.shape[1]), -np.inf)
    past[-1] = 0
    q = np.vstack([p, np.full((1, p.shape[1]), -np.inf)])  # -1 is the last row
    for a in range(0, len(word), STRETCH):
        lead = min(a, back - 1)
        grid = lattice([word[a - lead : a + STRETCH]], pieces)[0, lead:]
        alpha = np.concatenate([past, np.empty((len(grid), p.shape[1]))])
        for j, ids in enumerate(grid):
            x = alpha[j : j + back][::-1] + q[ids]
            top = x.max(0)
            alpha[j + back] = top + np.log(np.exp(x - top).sum(0))
        past = alpha[-back:]
    return past[-1]


def groups(words: list[str]):
    """Places of words of like length, few enough to be worked on together."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    a = 0
    while a < len(order):
        b = a + 1
        while b < len(order) and (b - a) < 4096 and (b + 1 - a) * len(words[order[b]]) <= 1 << 16:
            b += 1
        yield order[a:b]
        a = b


def word_scores(words: list[str], pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """(words, languages) log probabilities. p: (languages, pieces)."""
    out = np.zeros((len(words), len(p)))
    log = np.log(p).T.copy()
    short = [i for i, w in enumerate(words) if len(w) <= LONG]
    for places in groups([words[i] for i in short]):
        part = [short[i] for i in places]
        alpha = forward(lattice([words[i] for i in part], pieces), log)
        out[part] = alpha[np.array([len(words[i]) for i in part]), np.arange(len(part))]
    for i, w in enumerate(words):
        if len(w) > LONG:
            out[i] = long_score(w, pieces, log)
    return out


def expected(words: list[str], counts: np.ndarray, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece, for one language, over all segmentations of all words."""
    total = np.zeros(p.shape[1])
    log = np.log(p).T.copy()
    for part in groups(words):
        grid = lattice([words[i] for i in part], pieces)
        alpha = forward(grid, log)[:, :, 0]
        ends, each = np.array([len(words[i]) for i in part]), np.arange(len(part))
        width = grid.shape[1]
        beta = np.full((width + 1, len(part)), -np.inf)
        beta[ends, each] = np.log(counts[part]) - alpha[ends, each]
        for j in range(width, 0, -1):
            for l in range(1, min(j, pieces.longest) + 1):  # noqa: E741
                who = np.flatnonzero((grid[:, j - 1, l - 1] >= 0) & (beta[j] > -np.inf))
                if len(who):
                    ids = grid[who, j - 1, l - 1]
                    x = log[ids, 0] + beta[j, who]
                    np.add.at(total, ids, np.exp(alpha[j - l, who] + x))
                    beta[j - l, who] = np.logaddexp(beta[j - l, who], x)
    return total


class Model:
    def __init__(self, names: list[str], pieces: list[str], p: np.ndarray):
        self.names, self.pieces, self.p = names, Pieces(pieces), p
        self.known: dict[str, int] = {}
        self.values = np.zeros((WORDS, len(names)))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        found = [LETTERS.findall(t.lower()) if t else [] for t in texts]
        if not self.names:
            return ["und"] * len(texts), [0.0] * len(texts)
        lengthy = [i for i, f in enumerate(found) if f and max(map(len, f)) >= LONG]
        if lengthy:
            if len(texts) == 1:
                return self.one(found[0])
            apart = set(lengthy)
            lang, score = self.predict([None if i in apart else t for i, t in enumerate(texts)])
            for i in lengthy:
                (lang[i],), (score[i],) = self.one(found[i])
            return lang, score
        new = list(set().union(*found) - self.known.keys()) if found else []
        if len(self.known) + len(new) > WORDS:
            self.known.clear()
            new = list(set().union(*found))
            if len(new) > WORDS:  # more words at once than are remembered: half the texts at a time
                if len(texts) == 1:
                    return self.one(found[0])
                half = len(texts) // 2
                a, b = self.predict(texts[:half]), self.predict(texts[half:])
                return a[0] + b[0], a[1] + b[1]
        if new:
            base = len(self.known)
            self.values[base : base + len(new)] = word_scores([MARK + w for w in new], self.pieces, self.p)
            self.known.update(zip(new, range(base, base + len(new))))
        lengths = np.array([len(f) for f in found])
        ids = np.array([k for f in found for k in map(self.known.__getitem__, f)], np.int64)
        sums = np.zeros((len(texts), len(self.names)))
        self.grouped(sums, ids, lengths)
        return self.decide(sums, lengths)

    def grouped(self, sums, ids, lengths):
        some = np.flatnonzero(lengths)
        starts = (np.cumsum(lengths) - lengths)[some]
        sums[some] = np.add.reduceat(self.values[ids], starts, axis=0)

    def one(self, words):
        """A single text, word by word in blocks: it has long words, or more words than are remembered."""
        total, c = np.zeros(len(self.names)), Counter(words)
        names = list(c)
        for a in range(0, len(names), WORDS // 4):
            part = names[a : a + WORDS // 4]
            total += np.array([c[w] for w in part]) @ word_scores([MARK + w for w in part], self.pieces, self.p)
        return self.decide(total[None], np.array([len(words)]))

    def decide(self, sums, lengths):
        z = np.exp(sums - sums.max(1, keepdims=True))
        post = z / z.sum(1, keepdims=True)
        best = post.argmax(1)
        return [self.names[b] if n else "und" for b, n in zip(best, lengths)], [float(post[i, b]) if n else 0.0 for i, (b, n) in enumerate(zip(best, lengths))]


def fit(texts: dict[str, list[str]], pieces: list[str], rounds: int = ROUNDS) -> tuple[list[str], list[str], np.ndarray]:
    """Languages, pieces and their probabilities (languages, pieces), from texts by language."""
    names = sorted(texts)
    where = Pieces(pieces)
    p = np.zeros((len(names), len(pieces)))
    for k, name in enumerate(names):
        c = Counter(MARK + w for t in texts[name] for w in LETTERS.findall(t.lower()))
        words, counts = list(c), np.array(list(c.values()), float)
        # long pieces start dearer by their length, as if letters were alike
        q = np.array([[20.0 ** -max(1, len(s)) for s in pieces]])
        for _ in range(rounds):
            if words:
                e = expected(words, counts, where, q)
                q = ((e + 1e-3) / (e + 1e-3).sum())[None]
        p[k] = np.maximum(q[0], FLOOR)
    return names, pieces, p


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def train(docs: DataFrame, path: str, sample: int = SAMPLE):
    ok = narrow(docs, "doc_id", "text", "lang").where((F.col("lang").isNotNull()) & (F.col("text").isNotNull()) & (crc_mod(F.col("doc_id"), 5) != 0))
    # by a uniform number of the id, twice as many as needed of each language, so that none is a window of many rows
    # (a row for each language comes to the driver, as it does for the model itself)
    share = [x for r in ok.groupBy("lang").agg(F.count("*").alias("n")).collect() for x in (F.lit(r.lang), F.lit(2.0 * sample / r.n))]
    if not share:
        return fit({}, load_pieces(path))
    few = ok.select("doc_id", "lang", uniform(F.col("doc_id")).alias("u")).where(F.col("u") < F.element_at(F.create_map(*share), F.col("lang")))
    w = Window.partitionBy("lang").orderBy("u", "doc_id")
    chosen = few.withColumn("n", F.row_number().over(w)).where(F.col("n") <= sample).select("doc_id", "lang")
    rows = ok.join(F.broadcast(chosen.distinct()), ["doc_id", "lang"]).select("doc_id", "lang", "text").collect()  # `sample` a language
    texts: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.doc_id, r.text)):
        texts.setdefault(r.lang, []).append(r.text)
    return fit(texts, load_pieces(path))


def languages(docs: DataFrame, path: str | None = None, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row for each row of docs(doc_id, text, lang)."""
    bounded_batches(docs.sparkSession)
    names, pieces, p = train(docs, path or default_pieces(), sample)

    def score(batches):
        m = Model(names, pieces, p)
        schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
        for b in batches:
            lang, s = m.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(s, pa.float64())], schema=schema)

    scored = narrow(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(score, "doc_id long, lang_pred string, score double")
    return scored.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
