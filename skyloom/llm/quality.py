"""Operator 3: quality by a convolutional network over bytes, in numpy.

Bytes are embedded; filters of WIDTH bytes slide over them in steps of STRIDE; their largest responses in overlapping
chunks, which cover the whole text, are rectified, and the mean and the maximum over the chunks together with a few
linear weights give one probability. Past its end every text is followed by blanks, so a score depends on nothing but
the text. Embedding, filters and weights are learned by Adam on at most SAMPLE labelled rows, in hash order of doc_id;
training and scoring read whole texts, in pieces of bounded memory.

Edge cases: null and empty texts are one chunk of padding; a null doc_id never trains and counts as not held out;
without labels of both kinds the score is the share of label 1 (0.5 without labels); an empty table gives an empty
result.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import bounded_batches, crc_mod, labelled_sample, narrow

EMBED, WIDTH, STRIDE, FILTERS = 8, 8, 4, 32
#: Positions in a pooling block, blocks in a chunk; neighbouring chunks share one block.
BLOCK, CHUNK = 16, 9
SAMPLE, EPOCHS, RATE, BATCH = 3000, 6, 0.01, 32
#: Bytes of texts that are worked on at once; longer texts are worked on in pieces of this size.
SLICE = 1 << 18
PAD = BLOCK * STRIDE


def init(seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    return {
        "emb": r.normal(0, 0.3, (256, EMBED)).astype("f4"),
        "conv": r.normal(0, 1 / np.sqrt(EMBED * WIDTH), (EMBED * WIDTH, FILTERS)).astype("f4"),
        "bias": np.zeros(FILTERS, "f4"),
        "out": r.normal(0, 0.1, 2 * FILTERS).astype("f4"),
        "zero": np.zeros(1, "f4"),
    }


def padded(data: bytes) -> np.ndarray:
    """Bytes with blanks up to a whole number of pooling blocks."""
    n = max(1, -(-len(data) // PAD)) * PAD
    return np.frombuffer(data.ljust(n, b" "), np.uint8)


def responses(m: dict, x: np.ndarray, ends: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Filter responses at each step over bytes x. The last filter of each stretch, which ends with a step in `ends`,
    sees `tail` (WIDTH - STRIDE bytes for each stretch) in place of the stretch that happens to follow."""
    half = STRIDE * EMBED
    e = m["emb"][x].reshape(-1, half)
    after = np.empty_like(e)
    after[:-1] = e[1:]
    after[ends] = m["emb"][tail].reshape(-1, half)
    return e @ m["conv"][:half] + after @ m["conv"][half:]


def block_tops(m: dict, texts: list[bytes]) -> list[np.ndarray]:
    """Largest responses in each pooling block of each text, which fit into memory together."""
    x = [padded(t) for t in texts]
    steps = np.array([len(p) // STRIDE for p in x])
    tops = responses(m, np.concatenate(x), np.cumsum(steps) - 1, np.full((len(x), WIDTH - STRIDE), 32, np.uint8)).reshape(-1, BLOCK, FILTERS).max(1)
    return np.split(tops, np.cumsum(steps // BLOCK)[:-1])


def pieces(t: bytes):
    """(first step, bytes, what follows them) of a text, in pieces of SLICE bytes."""
    step = max(1, SLICE // PAD) * PAD
    for a in range(0, max(1, len(t)), step):
        yield a // STRIDE, padded(t[a : a + step]), np.frombuffer(t[a + step : a + step + WIDTH - STRIDE].ljust(WIDTH - STRIDE, b" "), np.uint8)


def long_tops(m: dict, t: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Largest responses in each pooling block of one text of any length, and the steps they are at."""
    tops, where = [], []
    for first, x, tail in pieces(t):
        r = responses(m, x, np.array([len(x) // STRIDE - 1]), tail[None]).reshape(-1, BLOCK, FILTERS)
        tops.append(r.max(1))
        where.append(r.argmax(1) + (first + np.arange(len(r)) * BLOCK)[:, None])
    return np.concatenate(tops), np.concatenate(where)


def chunks_of(blocks: int) -> list[tuple[int, int]]:
    """Ranges of blocks: each chunk starts at the last block of the one before it."""
    out, a = [], 0
    while True:
        out.append((a, min(blocks, a + CHUNK)))
        if a + CHUNK >= blocks:
            return out
        a += CHUNK - 1


def pooled(m: dict, texts: list[bytes]) -> np.ndarray:
    """Mean and maximum over chunks of rectified chunk maxima: a row for each text."""
    out = np.zeros((len(texts), 2 * FILTERS), "f4")
    a = 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b]) <= SLICE):
            size += len(texts[b])
            b += 1
        for i, tops in zip(range(a, b), block_tops(m, texts[a:b]) if size <= SLICE else [long_tops(m, texts[a])[0]]):
            out[i] = combine(m, tops)
        a = b
    return out


def combine(m: dict, blocks: np.ndarray) -> np.ndarray:
    starts = [a for a, _ in chunks_of(len(blocks))]
    top = np.maximum.reduceat(blocks, starts, axis=0)
    ends = [b - 1 for _, b in chunks_of(len(blocks))]
    c = np.maximum(np.maximum(top, blocks[ends]) + m["bias"], 0)
    return np.concatenate([c.mean(0), c.max(0)])


def probabilities(m: dict, texts: list[bytes]) -> np.ndarray:
    z = pooled(m, texts) @ m["out"] + m["zero"]
    return 1 / (1 + np.exp(-np.clip(z.astype("f8"), -30, 30)))


def gradients(m: dict, text: bytes, y: int) -> dict[str, np.ndarray]:
    """Gradient of the log loss for one text."""
    top, arg = long_tops(m, text)
    spans = chunks_of(len(top))
    pre = np.array([top[a:b].max(0) for a, b in spans]) + m["bias"]
    where = np.array([arg[a:b][top[a:b].argmax(0), np.arange(FILTERS)] for a, b in spans])
    c = np.maximum(pre, 0)
    f = np.concatenate([c.mean(0), c.max(0)])
    p = 1 / (1 + np.exp(-np.clip(float(f @ m["out"] + m["zero"][0]), -30, 30)))
    d = np.float32(p - y)
    g = {"out": d * f, "zero": np.array([d], "f4")}
    dc = np.repeat((d * m["out"][:FILTERS] / len(c))[None], len(c), 0)
    dc[c.argmax(0), np.arange(FILTERS)] += d * m["out"][FILTERS:]
    dc *= pre > 0
    g["bias"] = dc.sum(0)
    rows, inverse = np.unique(where, return_inverse=True)
    dr = np.zeros((len(rows), FILTERS), "f4")
    np.add.at(dr, (inverse.reshape(where.shape), np.arange(FILTERS)[None].repeat(len(c), 0)), dc)
    seen = np.concatenate([padded(text), np.full(WIDTH, 32, np.uint8)])[rows[:, None] * STRIDE + np.arange(WIDTH)]
    e = m["emb"][seen].reshape(len(rows), -1)
    g["conv"] = e.T @ dr
    g["emb"] = np.zeros_like(m["emb"])
    np.add.at(g["emb"], seen.reshape(-1), (dr @ m["conv"].T).reshape(-1, EMBED))
    return g


def fit(rows: list[tuple[int, str, int]], epochs: int = EPOCHS, seed: int = 7) -> dict[str, np.ndarray]:
    rows = sorted(rows)
    m = init(seed)
    y = [r[2] for r in rows]
    if len(set(y)) < 2:
        share = sum(y) / len(y) if y else 0.5
        return m | {"out": np.zeros(2 * FILTERS, "f4"), "zero": np.array([np.log((share + 1e-6) / (1 - share + 1e-6))], "f4")}
    data = [(t.encode("utf-8", "replace"), k) for _, t, k in rows]
    r = np.random.default_rng(seed)
    first, second, step = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}, 0
    for epoch in range(epochs):
        order = r.permutation(len(data))
        for a in range(0, len(order), BATCH):
            total = {k: np.zeros_like(v) for k, v in m.items()}
            for i in order[a : a + BATCH]:
                for k, v in gradients(m, *data[i]).items():
                    total[k] += v
            step += 1
            for k in m:
                g = total[k] / BATCH + 1e-5 * m[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                m[k] = m[k] - np.float32(RATE * (1 - epoch / epochs)) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                m[k] = m[k].astype("f4")
    return m


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of docs(doc_id, text)."""
    bounded_batches(docs.sparkSession)
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    rows = labelled_sample(docs, labels, "quality", lambda i: crc_mod(i, 3) != 1, sample)
    model = fit([(r.doc_id, r.text, r.y) for r in rows.collect()])  # at most `sample` rows

    def score(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
        for b in batches:
            texts = [(t or "").encode("utf-8", "replace") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(probabilities(model, texts), pa.float64())], schema=schema)

    scored = narrow(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
