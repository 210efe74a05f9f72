"""Language identification: a bidirectional gated recurrent network over bytes, in numpy.

Texts are cut into windows of WINDOW bytes (the last one is padded and masked). Two gated recurrent
layers read each window in either direction; both states of every byte give its label distribution,
and a document's probabilities are the mean over its bytes. Training is backpropagation through time
with Adam on windows of a bounded sample of labelled rows (TRAIN_ROWS rows by hash order of the id,
WINDOWS_A_ROW windows each); prediction reads every byte of every text, in one pass without a shuffle.

Null texts and texts without a letter are ``und`` with score 0. Repeated rows are labelled alike; null
ids pass through and train nothing; an id that many rows have counts with ROWS_AN_ID of them at most in
training; an empty table gives an empty result; without labelled rows every text is ``und``; extra columns
are ignored, and kept ones may have any name but those of the two results. Memory is bounded by a chunk of texts or one long text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm.common import chunks, free_name, text_bytes, tidy

WINDOW, HIDDEN = 64, 8
#: Bounds of the training sample, and its passes.
TRAIN_ROWS, WINDOWS_A_ROW, STEPS, BATCH = 3_000, 3, 160, 192
#: Rows of one id that train, so that a repeated id cannot fill the driver.
ROWS_AN_ID = 4
#: Windows labelled at once: their states stay in the processor's cache.
LANES = 2048
UNKNOWN = "und"


class Network:
    """Weights by name; ``f`` and ``b`` are the two directions. Gates are stacked: update, reset, candidate."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.langs, self.hidden = langs, hidden
        self.w: dict[str, np.ndarray] = {}
        for d in "fb":
            self.w[d + "x"] = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
            self.w[d + "h"] = rng.normal(0, 1 / np.sqrt(hidden), (3 * hidden, hidden)).astype(np.float32)
            self.w[d + "c"] = np.zeros((3 * hidden, 1), np.float32)
        self.w["o"] = rng.normal(0, 0.3, (len(langs), 2 * hidden)).astype(np.float32)
        self.w["ob"] = np.zeros((len(langs), 1), np.float32)

    # training ------------------------------------------------------------------------------------

    def _forward(self, d: str, x: np.ndarray) -> tuple[np.ndarray, list]:
        """States (time, hidden, lane) of bytes (time, lane) in reading order, and what the way back needs."""
        n = self.hidden
        wx, wh, c = self.w[d + "x"], self.w[d + "h"], self.w[d + "c"]
        h = np.zeros((n, x.shape[1]), np.float32)
        states, tape = [], []
        for row in x:
            a, u = wx[row].T + c, wh @ h
            z = 1 / (1 + np.exp(-(a[:n] + u[:n])))
            r = 1 / (1 + np.exp(-(a[n : 2 * n] + u[n : 2 * n])))
            m = np.tanh(a[2 * n :] + r * u[2 * n :])
            tape.append((row, h, z, r, m, u[2 * n :]))
            h = m + z * (h - m)
            states.append(h)
        return np.stack(states), tape

    def _backward(self, d: str, tape: list, given: np.ndarray, grad: dict[str, np.ndarray]) -> None:
        """Adds the gradients of one direction; ``given``: those of its states."""
        n = self.hidden
        wh = self.w[d + "h"]
        dh = np.zeros_like(given[0])
        for (row, h, z, r, m, u), g in zip(reversed(tape), given[::-1], strict=True):
            dh = dh + g
            dm = dh * (1 - z) * (1 - m * m)
            dz = dh * (h - m) * z * (1 - z)
            dr = dm * u * r * (1 - r)
            da = np.concatenate([dz, dr, dm])
            du = np.concatenate([dz, dr, dm * r])
            np.add.at(grad[d + "x"], row, da.T)
            grad[d + "c"] += da.sum(axis=1, keepdims=True)
            grad[d + "h"] += du @ h.T
            dh = dh * z + wh.T @ du

    def loss(self, x: np.ndarray, y: np.ndarray, grad: dict[str, np.ndarray] | None = None) -> float:
        """Mean cross-entropy of all positions of windows x (lane, time) with labels y; adds gradients."""
        xt = x.T
        hf, tf = self._forward("f", xt)
        hb, tb = self._forward("b", xt[::-1])
        h = np.concatenate([hf, hb[::-1]], axis=1)
        logits = self.w["o"] @ h + self.w["ob"]
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        lanes = np.arange(len(y))
        out = float(-np.log(np.maximum(1e-9, p[:, y, lanes])).mean())
        if grad is not None:
            p[:, y, lanes] -= 1
            p /= p.shape[0] * p.shape[2]
            grad["o"] += np.einsum("tkb,thb->kh", p, h)
            grad["ob"] += p.sum(axis=(0, 2))[:, None]
            dh = self.w["o"].T @ p
            self._backward("f", tf, dh[:, : self.hidden], grad)
            self._backward("b", tb, dh[::-1, self.hidden :], grad)
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = 0.02, seed: int = 5) -> None:
        """Adam on batches with labels in equal shares."""
        rng = np.random.default_rng(seed)
        by = [np.flatnonzero(y == k) for k in range(len(self.langs))]
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        s = {k: np.zeros_like(v) for k, v in self.w.items()}
        for step in range(1, steps + 1):
            at = np.concatenate([rng.choice(i, max(1, batch // len(by))) for i in by])
            grad = {k: np.zeros_like(v) for k, v in self.w.items()}
            self.loss(x[at], y[at], grad)
            lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.99 * s[k] + 0.01 * g * g
                self.w[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-6)

    # prediction ----------------------------------------------------------------------------------

    def prepare(self) -> None:
        """Tables for prediction: biases folded in, gate rows halved so that one tanh serves all gates."""
        n = self.hidden
        half = np.ones((3 * n, 1), np.float32)
        half[: 2 * n] = 0.5
        self.tables = {d: (np.ascontiguousarray((self.w[d + "x"].T + self.w[d + "c"]).T * half.T), self.w[d + "h"] * half) for d in "fb"}

    def _run(self, d: str, x: np.ndarray, out: np.ndarray) -> None:
        """States of bytes x (time, lane) into out (time, hidden, lane), in reading order."""
        n = self.hidden
        table, wh = self.tables[d]
        lanes = x.shape[1]
        h = np.zeros((n, lanes), np.float32)
        u, g = np.empty((3 * n, lanes), np.float32), np.empty((2 * n, lanes), np.float32)
        for t in range(len(x)):
            a = table[x[t]].T
            np.matmul(wh, h, out=u)
            np.add(u[: 2 * n], a[: 2 * n], out=g)
            np.tanh(g, out=g)
            g *= 0.5
            g += 0.5
            m = u[2 * n :]
            m *= g[n:]
            m += a[2 * n :]
            np.tanh(m, out=m)
            h -= m
            h *= g[:n]
            h += m
            out[t] = h

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Label probabilities (time, label, lane) of windows x (lane, time)."""
        xt = np.ascontiguousarray(x.T)
        h = np.empty((xt.shape[0], 2 * self.hidden, xt.shape[1]), np.float32)
        self._run("f", xt, h[:, : self.hidden])
        self._run("b", xt[::-1], h[::-1, self.hidden :])
        p = self.w["o"] @ h
        p += self.w["ob"]
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p

    def documents(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean probabilities (row, label) over all bytes of each row; zero for an empty row."""
        sizes = np.diff(offsets)
        per = -(-sizes // WINDOW)
        total = int(per.sum())
        rows = np.repeat(np.arange(len(sizes)), per)
        first = np.concatenate([[0], np.cumsum(per)])[:-1]
        begins = offsets[rows] + (np.arange(total) - first[rows]) * WINDOW
        lengths = np.minimum(WINDOW, offsets[rows + 1] - begins)
        padded = np.concatenate([buf, np.zeros(WINDOW, np.uint8)])
        sums = np.zeros((len(sizes), len(self.langs)))
        steps = np.arange(WINDOW)
        for k in range(0, total, LANES):
            b, n = begins[k : k + LANES], lengths[k : k + LANES]
            inside = steps[:, None] < n[None, :]
            x = np.where(inside.T, padded[b[:, None] + steps[None, :]], 0).astype(np.uint8)
            p = self.positions(x)
            p *= inside[:, None, :]
            np.add.at(sums, rows[k : k + LANES], p.sum(axis=0).T)
        return sums / np.maximum(1, sizes)[:, None]


def windows_of(df: DataFrame, text: str, lang: str, key: str) -> DataFrame:
    """Up to WINDOWS_A_ROW windows of each row, evenly spread, as binary with the row's label."""
    schema = T.StructType([T.StructField("window", T.BinaryType()), T.StructField("lang", T.StringType()), T.StructField("key", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text_, lang_, key in zip(*[batch.column(c).to_pylist() for c in ("text", "lang", "key")], strict=True):
                raw = text_.encode()
                spare = max(0, len(raw) - WINDOW)
                rows += [(raw[s : s + WINDOW].ljust(WINDOW, b"\0"), lang_, key) for s in sorted({spare * i // max(1, WINDOWS_A_ROW - 1) for i in range(WINDOWS_A_ROW)})]
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.string(), pa.int64()), strict=True)], names=schema.names)

    of_id = Window.partitionBy(key).orderBy(F.xxhash64(text, lang), lang)
    few = df.where(F.length(text) > 0).select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(key, text, lang).alias("key"), F.row_number().over(of_id).alias("place"))
    return few.where(F.col("place") <= ROWS_AN_ID).select("text", "lang", "key").mapInArrow(tidy("langid", run), schema)


def train(df: DataFrame, where: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", most: int = TRAIN_ROWS) -> Network:
    """The network of at most ``most`` labelled rows for which ``where`` (over ``key``) holds."""
    marked = df.where(where & F.col(lang).isNotNull() & F.col(key).isNotNull()).select(key).distinct().orderBy(F.xxhash64(key), key).limit(most)
    # at most ``most`` ids: small whatever the table's size
    rows = windows_of(df.select(key, text, lang).where(F.col(lang).isNotNull()).join(F.broadcast(marked), key), text, lang, key).collect()
    rows = sorted((r[2], bytes(r[0]), r[1]) for r in rows)
    langs = sorted({r[2] for r in rows})
    net = Network(langs)
    if langs:
        x = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(-1, WINDOW)
        net.fit(x, np.array([langs.index(r[2]) for r in rows]))
    net.prepare()
    return net


def has_letter(buf: np.ndarray, offsets: np.ndarray, column: pa.Array) -> np.ndarray:
    """Rows with a letter; only rows without a-z and with other than ASCII bytes are looked at singly."""
    low = buf | 32
    sums = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122) & (buf < 128))])
    wide = np.concatenate([[0], np.cumsum(buf >= 128)])
    found = sums[offsets[1:]] > sums[offsets[:-1]]
    for i in np.flatnonzero(~found & (wide[offsets[1:]] > wide[offsets[:-1]])):
        found[i] = any(c.isalpha() for c in column[int(i)].as_py())
    return found


def predict(df: DataFrame, net: Network, text: str = "text", keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` with lang_pred and score, the pooled probability of that language, under ``names``."""
    kept = list(keep)
    read = text if text in kept else free_name(df, "text_")  # the text is carried once
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, read):
            column = batch.column(read)
            buf, offsets = text_bytes(column)
            known = has_letter(buf, offsets, column) & bool(net.langs)
            lang, score = [UNKNOWN] * len(column), np.zeros(len(column))
            if known.any():
                p = net.documents(buf, offsets)
                best = p.argmax(axis=1)
                lang = [net.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                score = np.where(known, np.clip(p.max(axis=1), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=schema.names)

    return df.select(*kept, *([] if text in kept else [F.col(text).alias(read)])).mapInArrow(tidy("langid", run), schema)
