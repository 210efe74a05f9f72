"""Quality classifier: Bradley-Terry pairwise ranking.

Preference pairs (a better and a worse labelled document) give differences of features; the weights
minimise the logistic loss on them, and a document's score is its weighted features: shares of words and
marks, and the shares of its words and byte trigrams (A-Z lower-cased) that are hashed into each of WORDS
and GRAMS columns. The threshold is the quantile of the training scores at the share of worse documents;
the reported score is the logistic of the distance to it, so 0.5 is the threshold.

The model is fitted on every labelled row: rows are dealt by hash into blocks of about BLOCK, each block gives
weights and a threshold from pairs in which all of its rows take part, and the model is their mean, weighted by
rows. A label too rare for blocks of that size has its rows in several of them; only the first counts in means
and thresholds. An id with several labels has the highest; each of its rows counts. Scores cover whole texts of all
rows, in one pass without a shuffle. Null texts are empty ones, whose score is that of zero features; repeated rows
score alike; null ids pass through; without rows of both labels every score is 0.5; extra columns are ignored, and
kept ones may have any name but that of the score. Memory is bounded by a block's distinct rows; the driver gets
one row of weights a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm.common import chunks, free_name, lowered, mix, span_hashes, tidy
from docweave.llm.quality_rules import Texts, _class

#: Labelled rows in a block and how many of each label it has at least, if there are so many; pairs of a block at least, and of each row.
BLOCK, EACH, PAIRS, PAIRS_A_ROW = 4_000, 40, 40_000, 10
#: Hashed columns of words and of byte trigrams.
WORDS, GRAMS = 512, 512
#: Passes over the pairs, pairs at once, and the weight of the ridge on hashed columns against that on the others.
PASSES, BATCH, HASHED_RIDGE = 8, 2_000, 30.0

#: Bytes of text and rows whose features are made at once.
AT_ONCE, ROWS_AT_ONCE = 1 << 19, 512

_EXCLAIM, _BAR, _STOP = _class("!?"), _class("|"), _class(".,;:")


def surface(t: Texts) -> np.ndarray:
    """Shares and capped logarithms, a row a text, zero for an empty text."""
    words, chars = np.maximum(1, t.n_words), np.maximum(1, t.word_chars)
    rows = t.spans[2]
    pairs = np.unique(mix(t.word_hashes ^ mix(rows.astype(np.uint64))), return_index=True)[1]
    distinct = np.bincount(rows[pairs], minlength=t.n)
    symbols = np.minimum(4, t.n_symbols / words)
    parts = [
        np.sqrt(symbols),
        symbols,
        np.sqrt(np.minimum(1, t.count("bar", _BAR) / words)),
        np.sqrt(np.minimum(2, t.count("exclaim", _EXCLAIM) / words)),
        t.upper_share(),
        np.maximum(0, t.upper_share() - 0.3),
        t.digit_share(),
        t.n_repeat_words / words,
        t.lines[1] / np.maximum(1, t.lines[0]),
        np.where(t.n_words > 0, 1 - distinct / words, 0),
        np.maximum(0, np.where(t.n_words > 0, 1 - distinct / words, 0) - 0.7),
        np.minimum(1, t.count("stop", _STOP) / words),
        np.log1p(np.minimum(t.n_words, 100_000)) / 10,
        np.minimum(4, np.where(t.n_words > 0, chars / words, 0) / 5),
    ]
    return np.stack(parts, axis=1).astype(np.float64)


def hashed(t: Texts) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """The columns of all lower-cased words and of all byte trigrams within texts, each with its row."""
    low = lowered(t.buf)
    starts, ends, rows = t.spans
    words = (span_hashes(low, starts, ends) % np.uint64(WORDS)).astype(np.int64)
    n = max(0, len(low) - 2)
    wide = low.astype(np.uint32)
    code = wide[:n] | wide[1 : n + 1] << np.uint32(8) | wide[2 : n + 2] << np.uint32(16)
    grams = (code * np.uint32(2654435761) >> np.uint32(32 - GRAMS.bit_length() + 1)).astype(np.int64)
    owner = np.repeat(np.arange(t.n), np.diff(t.offsets))
    inside = owner[:n] == owner[2:] if n else np.zeros(0, bool)
    return (words, rows), (grams[inside], owner[:n][inside])


def features(column: pa.Array) -> np.ndarray:
    """All features of whole texts, a row each."""
    t = Texts(column)
    parts = [surface(t)]
    for (code, rows), width in zip(hashed(t), (WORDS, GRAMS), strict=True):
        counts = np.bincount(rows * width + code, minlength=t.n * width).reshape(t.n, width)
        parts.append(np.sqrt(counts / np.maximum(1, counts.sum(axis=1, keepdims=True))))
    return np.concatenate(parts, axis=1).astype(np.float32)


@dataclass(frozen=True)
class Ranker:
    weights: np.ndarray
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights - self.threshold, -30, 30)))


def dealt(rng: np.random.Generator, rows: np.ndarray, n: int) -> np.ndarray:
    """``n`` of the rows in random order, each as often as any other or once more."""
    return np.concatenate([rng.permutation(rows) for _ in range(-(-n // len(rows)))])[:n]


def fit(x: np.ndarray, good: np.ndarray, often: np.ndarray, own: np.ndarray, worse_share: float, ridge: float = 1e-3, seed: int = 7) -> Ranker:
    """Weights from preference pairs: Adam on the logistic loss of feature differences. ``often``: how often a row
    is there; ``own``: whether it counts in means and the threshold, which is the quantile at ``worse_share``."""
    d = x.shape[1]
    better, worse = np.repeat(np.flatnonzero(good), often[good]), np.repeat(np.flatnonzero(~good), often[~good])
    weight = often * own
    mean = np.average(x, axis=0, weights=weight)
    scale = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=weight))
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = ((x - mean) / scale).astype(np.float32)
    rng = np.random.default_rng(seed)
    pairs = max(PAIRS, PAIRS_A_ROW * (len(better) + len(worse)))
    first, second = dealt(rng, better, pairs), dealt(rng, worse, pairs)
    hold = np.full(d, ridge)
    hold[max(0, d - WORDS - GRAMS) :] *= HASHED_RIDGE
    w, m, s = np.zeros(d), np.zeros(d), np.zeros(d)
    step, steps = 0, PASSES * -(-pairs // BATCH)
    for _ in range(PASSES):
        for k in range(0, pairs, BATCH):
            step += 1
            diff = z[first[k : k + BATCH]] - z[second[k : k + BATCH]]
            p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))  # chance of the wrong order
            g = hold * w - (diff * p[:, None]).mean(axis=0)
            m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
            w -= 0.05 * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    threshold = float(np.quantile(np.repeat(z @ w, weight), worse_share))
    w = w / scale
    return Ranker(w, threshold + float(mean @ w))


def gathered(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rows of a block in an order of their own: features, label, how often, and whether they count."""
    found: dict[bytes, list] = {}
    for batch in chunks(batches, "text", AT_ONCE):
        for k in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(k, ROWS_AT_ONCE)
            for x, good, own in zip(features(part.column("text")), part.column("good").to_pylist(), part.column("own").to_pylist(), strict=True):
                row = found.setdefault(blake2b(x.tobytes() + bytes([good, own]), digest_size=16).digest(), [x, good, 0, own])
                row[2] += 1
    rows = [found[k] for k in sorted(found)]
    return np.stack([r[0] for r in rows]), *(np.array([r[i] for r in rows], t) for i, t in ((1, bool), (2, np.int64), (3, bool)))


def train(docs: DataFrame, labels: DataFrame, where: Column, text: str = "text", key: str = "doc_id", label: str = "quality", block: int = BLOCK) -> Ranker:
    """The ranker of all rows with a label for whose id ``where`` (over ``key``) holds, in blocks of about ``block``."""
    marked = labels.where(where & F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg((F.max(label) == 1).alias("good"))
    count = docs.select(F.col(key).alias("key")).join(marked, "key").agg(F.count_if("good"), F.count_if(~F.col("good"))).first()
    if not min(count):
        return Ranker(np.zeros(features(pa.array([""])).shape[1]), 0.0)
    blocks, worse_share = -(-sum(count) // block), count[1] / sum(count)
    times = [min(blocks, -(-EACH * blocks // n)) for n in count]
    # dealt by key whatever the size of the labels, which grow with the corpus; only they are held
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(marked.hint("shuffle_hash"), "key")
    turns = F.when(F.col("good"), times[0]).otherwise(times[1])
    rows = rows.withColumn("turn", F.explode(F.sequence(F.lit(0), turns - 1)))
    rows = rows.select("text", "good", (F.col("turn") == 0).alias("own"), F.pmod(F.xxhash64("key", "text") + F.col("turn"), F.lit(blocks)).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, good, often, own = gathered(batches)
        if own.any() and good.any() and not good.all():
            model = fit(x, good, often, own, worse_share)
            yield pa.RecordBatch.from_arrays([pa.array([int((often * own).sum())]), pa.array([model.threshold]), pa.array([model.weights])], names=["n", "threshold", "weights"])

    parts = rows.groupBy("block").applyInArrow(tidy("quality_rank", run), "n long, threshold double, weights array<double>").collect()
    # sums in an order of their own, so that the model is the same each time
    parts.sort(key=lambda p: (p.n, p.threshold, p.weights))
    n = np.array([p.n for p in parts]) / sum(p.n for p in parts)
    return Ranker(n @ np.array([p.weights for p in parts]), float(n @ np.array([p.threshold for p in parts])))


def score(df: DataFrame, model: Ranker, text: str = "text", keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """``keep`` with the score, in (0, 1), as ``name``."""
    kept = list(keep)
    read = text if text in kept else free_name(df, "text_")  # the text is carried once
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, read, AT_ONCE):
            parts = [model.score(features(batch.slice(k, ROWS_AT_ONCE).column(read))) for k in range(0, batch.num_rows, ROWS_AT_ONCE)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(np.concatenate(parts))], names=schema.names)

    return df.select(*kept, *([] if text in kept else [F.col(text).alias(read)])).mapInArrow(tidy("quality_rank", run), schema)
