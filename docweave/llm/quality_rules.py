"""Quality rules: a short-circuit cascade ordered by rejection per cost.

``estimate`` takes a sample of rows by their hashes (SAMPLE rows, SAMPLE_BYTES bytes) and picks the rules one
by one: each has the seconds a row that it needs beside what the rules before it made already, and the share
that it rejects of the rows that these kept; the one with the most rejection per second comes next.
``apply_rules`` evaluates the rules in that order on whole texts, each only on the rows that every earlier
rule kept; what is made of a text (words, counts, lines) is kept for the rules after. The order changes the
cost, never the verdict. No shuffle; memory is bounded by a chunk of texts or one long text.

A null text is an empty one (no words). Repeated rows get equal values, null ids pass through, an
empty table gives an empty result (rules keep their given order); extra columns are ignored.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm.common import chunks, mix, row_sums, shingle_hashes, span_hashes, text_bytes, word_spans

#: Rows that costs and selectivities are estimated on, and bytes of them (longer texts are left out of the sample).
SAMPLE, SAMPLE_BYTES = 500, 16 << 20
#: Fixed values of the base rules.
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30


def _class(values: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(values.encode())] = True
    return table


_SYMBOL = _class("#*$%&|<>")
_UPPER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOWER = _class("abcdefghijklmnopqrstuvwxyz")
_DIGIT = _class("0123456789")
_FIRST_BYTE = np.array([not 0x80 <= b < 0xC0 for b in range(256)])


class Texts:
    """A chunk of texts with what the rules share, each part made on first use."""

    def __init__(self, column: pa.Array):
        self.buf, self.offsets = text_bytes(column)
        self.n = len(column)
        self._made: dict[str, object] = {}

    def _once(self, name: str, make: Callable[[], object]):
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    def narrowed(self, alive: np.ndarray) -> Texts:
        """Only some of the rows, with what was made of them."""
        out = Texts.__new__(Texts)
        sizes = np.diff(self.offsets)
        inside = np.zeros(self.n, bool)
        inside[alive] = True
        out.n, out.offsets, out.buf = len(alive), np.concatenate([[0], np.cumsum(sizes[alive])]), self.buf[np.repeat(inside, sizes)]
        number = np.cumsum(inside) - 1
        of_words = inside[self._made["spans"][2]] if "spans" in self._made else None

        def cut(name: str, value):
            if name == "spans":
                starts, ends, rows = (x[of_words] for x in value)
                shift = out.offsets[number[rows]] - self.offsets[rows]
                return starts + shift, ends + shift, number[rows]
            if name == "word_hashes":
                return value[of_words]
            return tuple(x[alive] for x in value) if isinstance(value, tuple) else value[alive]

        out._made = {name: cut(name, value) for name, value in self._made.items()}
        return out

    def again(self) -> Texts:
        """The same rows, to make more of them apart."""
        out = Texts.__new__(Texts)
        out.n, out.offsets, out.buf, out._made = self.n, self.offsets, self.buf, dict(self._made)
        return out

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    def count(self, name: str, table: np.ndarray) -> np.ndarray:
        return self._once(name, lambda: self.per_row(table[self.buf]))

    @property
    def spans(self):
        return self._once("spans", lambda: word_spans(self.buf, self.offsets))

    @property
    def n_words(self) -> np.ndarray:
        return self._once("n_words", lambda: np.bincount(self.spans[2], minlength=self.n).astype(np.int64))

    @property
    def word_hashes(self) -> np.ndarray:
        return self._once("word_hashes", lambda: span_hashes(self.buf, *self.spans[:2]))

    @property
    def word_chars(self) -> np.ndarray:
        """Code points in words: first bytes of code points, but for white space."""
        space = np.zeros(256, bool)
        space[[0x20, *range(0x09, 0x0E)]] = True
        return self._once("word_chars", lambda: self.per_row((_FIRST_BYTE & ~space)[self.buf]))

    @property
    def n_symbols(self) -> np.ndarray:
        return self.count("n_symbols", _SYMBOL)

    @property
    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines with a word, and those of them that equal an earlier line, by row."""

        def make():
            feeds = np.flatnonzero(self.buf == 10)
            owner = np.searchsorted(self.offsets, feeds, side="right") - 1
            starts = np.concatenate([self.offsets[:-1], feeds + 1])
            rows = np.concatenate([np.arange(self.n), owner])
            order = np.lexsort((starts, rows))
            starts, rows = starts[order], rows[order]
            # a line ends before the next line of its row, or with the row
            ends = self.offsets[rows + 1].copy()
            inner = np.flatnonzero(rows[1:] == rows[:-1])
            ends[inner] = starts[inner + 1] - 1
            heads = self.spans[0]
            full = np.searchsorted(heads, starts) < np.searchsorted(heads, ends)
            starts, ends, rows = starts[full], ends[full], rows[full]
            keys = mix(span_hashes(self.buf, starts, ends) ^ mix(rows.astype(np.uint64)))
            _, first = np.unique(keys, return_index=True)
            total = np.bincount(rows, minlength=self.n)
            return total, total - np.bincount(rows[first], minlength=self.n)

        return self._once("lines", make)

    @property
    def n_repeat_words(self) -> np.ndarray:
        """Words covered by WINDOW-word windows that the row has twice or more."""

        def make():
            rows = self.spans[2]
            windows, at = shingle_hashes(self.word_hashes, rows, WINDOW)
            if not len(at):
                return np.zeros(self.n, np.int64)
            keys = mix(windows ^ mix(rows[at].astype(np.uint64)))
            _, which, times = np.unique(keys, return_inverse=True, return_counts=True)
            again = at[times[which] > 1]
            edge = np.zeros(len(rows) + 1, np.int64)
            np.add.at(edge, again, 1)
            np.add.at(edge, again + WINDOW, -1)
            return row_sums(np.cumsum(edge[:-1]) > 0, rows, self.n)

        return self._once("n_repeat_words", make)

    def upper_share(self) -> np.ndarray:
        upper = self.count("upper", _UPPER)
        return upper / np.maximum(1, upper + self.count("lower", _LOWER))

    def digit_share(self) -> np.ndarray:
        return self.count("digit", _DIGIT) / np.maximum(1, self.word_chars)

    def base_failed(self) -> np.ndarray:
        return (self.n_words < MIN_WORDS) | (100 * self.n_repeat_words > MAX_REPEAT_PERCENT * self.n_words)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Texts], np.ndarray]


#: The production rules: each rejects a kind of junk on its own evidence.
RULES = (
    Rule("too_few_words", lambda t: t.n_words < MIN_WORDS),
    Rule("symbols", lambda t: 10 * t.n_symbols > 3 * t.n_words),
    Rule("shouting", lambda t: t.upper_share() > 0.6),
    Rule("digits", lambda t: t.digit_share() > 0.4),
    Rule("word_length", lambda t: (t.word_chars < 2 * t.n_words) | (t.word_chars > 20 * t.n_words)),
    Rule("repeated_lines", lambda t: (t.lines[0] >= 4) & (2 * t.lines[1] > t.lines[0])),
    Rule("repeated_words", lambda t: 100 * t.n_repeat_words > MAX_REPEAT_PERCENT * t.n_words),
)


def sampled(df: DataFrame, text: str, sample: int) -> pa.Array:
    """Texts of the first ``sample`` rows by hash, as far as they have SAMPLE_BYTES together."""
    h = F.xxhash64(*[c for c in df.columns if df.schema[c].dataType.typeName() not in ("map", "variant")], F.lit(5))
    rows = df.select(h.alias("h"), F.octet_length(text).alias("size")).orderBy("h").limit(sample).collect()
    room, chosen = SAMPLE_BYTES, []
    for row in rows:
        if (row.size or 0) <= room:
            room -= row.size or 0
            chosen.append(row.h)
    if not chosen:
        return pa.array([], pa.string())
    # equal rows have one hash: one of them counts
    found = df.select(h.alias("h"), F.col(text).alias("text")).where(F.col("h").isin(chosen)).groupBy("h").agg(F.first("text").alias("text")).orderBy("h")
    return pa.array([r.text for r in found.collect()], pa.string())


def estimate(df: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample: int = SAMPLE) -> list[tuple[Rule, float, float]]:
    """Rules in the order to run, each with the seconds a row and the share of rows rejected, after those before it."""
    column = sampled(df, text, sample)
    if not len(column):
        return [(r, 0.0, 0.0) for r in rules]
    for rule in rules:  # tables that all chunks share are made before time counts
        rule.rejects(Texts(column))
    left, found, now = list(rules), [], Texts(column)
    while left:
        tried = []
        for rule in left:
            texts = now.again()
            begun = time.perf_counter()
            gone = rule.rejects(texts)
            tried.append((rule, max(1e-9, (time.perf_counter() - begun) / now.n), float(gone.mean()), gone, texts))
        rule, cost, share, gone, texts = max(tried, key=lambda x: x[2] / x[1])
        found.append((rule, cost, share))
        left.remove(rule)
        if gone.all():
            # nothing is left to measure on: the others in the order of what they cost the last rows
            return found + [x[:3] for x in sorted((t for t in tried if t[0] is not rule), key=lambda x: -x[2] / x[1])]
        now = texts.narrowed(np.flatnonzero(~gone)) if gone.any() else texts
    return found


def keep(texts: Texts, rules: Sequence[Rule]) -> np.ndarray:
    """The cascade on one chunk: each rule sees what the earlier ones kept, with what they made of it."""
    out = np.zeros(texts.n, bool)
    alive = np.arange(texts.n)
    for rule in rules:
        gone = rule.rejects(texts)
        if gone.any():
            kept = np.flatnonzero(~gone)
            alive = alive[kept]
            if not len(alive):
                return out
            texts = texts.narrowed(kept)
    out[alive] = True
    return out


def apply_rules(df: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", key: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """Per row ``key`` and kept: whether every rule keeps the text."""
    ordered = [r for r, _, _ in estimate(df, rules, text, sample)]
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("kept", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(keep(Texts(batch.column("text")), ordered))], names=schema.names)

    return df.select(key, text).toDF("key", "text").mapInArrow(run, schema)


def with_base(df: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", key: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """Per row ``key``, the base counts, base_failed, and kept: the cascade's verdict where the base rules pass."""
    ordered = [r for r, _, _ in estimate(df, rules, text, sample)]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *[T.StructField(n, T.LongType()) for n in names], *[T.StructField(n, T.BooleanType()) for n in ("base_failed", "kept")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            t = Texts(batch.column("text"))
            failed = t.base_failed()
            counts = (t.n_words, t.word_chars, t.n_symbols, t.lines[1], t.n_repeat_words)
            # every row has its base counts; the cascade sees those that the base rules keep
            passed = np.flatnonzero(~failed)
            kept = np.zeros(t.n, bool)
            if len(passed):
                kept[passed] = keep(t.narrowed(passed) if len(passed) < t.n else t, ordered)
            yield pa.RecordBatch.from_arrays([batch.column("key"), *[pa.array(c, pa.int64()) for c in counts], pa.array(failed), pa.array(kept)], names=schema.names)

    return df.select(key, text).toDF("key", "text").mapInArrow(run, schema)
