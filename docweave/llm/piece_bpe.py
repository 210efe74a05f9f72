"""SentencePiece merge-type vocabularies: a score-ordered agenda of adjacent symbol pairs.

A text is escaped (space as U+2581, one in front) and cut where no piece can cross: before a run of
U+2581 and around line feeds; new units also between a letter and a sign that no piece has behind letters. Each
distinct part is merged by the agenda and kept, like units, in a bounded cache of the worker that loses those
unused longest; all new parts of an Arrow batch are checked against the sentencepiece library.

Nulls in the text column count as empty texts (no ids, decoded to an empty text); ids of rows pass
through, null or repeated; extra columns are ignored. A null, repeated or very long text needs no
other rule: units bound the agenda, not texts; a unit without spaces costs n log n.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import operator
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docweave.llm.common import Recent, chunks

MARK = "▁"
_UNITS = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
_LETTER = re.compile(r"[^\W\d_]")


class PieceVocabulary:
    """Pieces, scores and byte fallbacks of a model file; encodes units by the agenda."""

    #: Units kept by a worker, those used last.
    CACHE = 400_000
    #: Symbols up to which a scan of the agenda is cheaper than a heap; above every score's rank.
    SHORT, NONE = 32, float("inf")

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib = self.library
        n = lib.get_piece_size()
        self.ids = {}
        self.rank = {}
        self.byte_ids = [0] * 256
        surface = []
        for i in range(n):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                surface.append(bytes([int(piece[3:5], 16)]))
            elif lib.is_control(i) or lib.is_unknown(i):
                surface.append(b"")
            else:
                surface.append(piece.replace(MARK, " ").encode())
                if not lib.is_unused(i):
                    self.ids[piece] = i
                    self.rank[piece] = -lib.get_score(i)
        pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        after = {b[1] for b in pairs if _LETTER.match(b[0])}
        marks = "".join(x for x in string.punctuation if x not in after and not _LETTER.match(x))
        # letters that a sign follows which no piece has behind a letter
        self.parts = re.compile(f"{MARK}*{_LETTER.pattern}+(?=[{re.escape(marks)}])|(?s:.)+") if marks else None
        if any("\n" in p or MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces of this model cross line feeds or marks; units can't be cut there")
        self.surface = pa.array(surface, pa.binary())
        self.units, self.merged = Recent(self.CACHE), Recent(self.CACHE)

    def merge(self, unit: str) -> list[int]:
        """Ids of one escaped unit: pops the pair of the highest score, the leftmost among equals."""
        symbols = self.short(unit) if len(unit) <= self.SHORT else self.long(unit)
        try:
            return [self.ids[s] for s in symbols]
        except KeyError:
            out: list[int] = []
            for s in symbols:
                i = self.ids.get(s)
                out.extend((i,) if i is not None else [self.byte_ids[b] for b in s.encode()])
            return out

    def short(self, unit: str) -> list[str]:
        """The agenda as a list beside the symbols: the best entry is found by a scan."""
        rank, symbols, none = self.rank.get, list(unit), self.NONE
        agenda = list(map(rank, map(operator.add, unit, unit[1:]), itertools.repeat(none)))
        while agenda and (best := min(agenda)) != none:
            i = agenda.index(best)
            joined = symbols[i] + symbols.pop(i + 1)
            symbols[i] = joined
            del agenda[i]
            if i < len(agenda):
                agenda[i] = rank(joined + symbols[i + 1], none)
            if i:
                agenda[i - 1] = rank(symbols[i - 1] + joined, none)
        return symbols

    def long(self, unit: str) -> list[str]:
        """The agenda as a heap with links between living symbols: n log n for a unit of n symbols."""
        rank, symbols = self.rank, list(unit)
        n = len(symbols)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in rank:
                agenda.append((rank[pair], i, pair))
        heapq.heapify(agenda)
        while agenda:
            _, left, joined = heapq.heappop(agenda)
            if not symbols[left]:
                continue
            right = after[left]
            if right >= n or symbols[left] + symbols[right] != joined:
                continue
            symbols[left], symbols[right] = joined, ""
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
            for a, b in ((before[left], left), (left, after[left])):
                if a >= 0 and b < n:
                    pair = symbols[a] + symbols[b]
                    if pair in rank:
                        heapq.heappush(agenda, (rank[pair], a, pair))
        return [s for s in symbols if s]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian 32-bit integers."""
        split = [_UNITS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        fresh = self.units.missing(set().union(*split))
        cache = self.units.young
        if fresh:
            parts = [self.parts.findall(u) for u in fresh] if self.parts else [[u] for u in fresh]
            new = self.merged.missing(set().union(*parts))
            known = self.merged.young
            merged = [self.merge(u) for u in new]
            if new:
                self.check(new, merged)
            raw, at = np.fromiter(itertools.chain.from_iterable(merged), "<i4").tobytes(), 0
            for u, ids in zip(new, merged, strict=True):
                known[u] = raw[at : (at := at + 4 * len(ids))]
            for u, of in zip(fresh, parts, strict=True):
                cache[u] = known[of[0]] if len(of) == 1 else b"".join([known[x] for x in of])
        return [b"".join(map(cache.__getitem__, units)) for units in split]

    def check(self, units: list[str], merged: list[list[int]]) -> None:
        """Raises if the library encodes the units, set between line feeds, otherwise."""
        feed = self.merge("\n")
        expected = self.merge(MARK)
        for ids in merged:
            expected.extend(feed)
            expected.extend(ids)
        got = self.library.encode("\n" + "\n".join(units).replace(MARK, " "), num_threads=1)
        if got != expected:
            raise ValueError("the agenda and the sentencepiece library disagree on a unit")

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of id sequences laid end to end; ``ends`` are their n + 1 offsets."""
        taken = self.surface.take(pa.array(ids, pa.int32()))
        at = np.frombuffer(taken.buffers()[1], np.int32)[: len(taken) + 1]
        data = taken.buffers()[2].to_pybytes() if len(taken) and taken.buffers()[2] else b""
        out = []
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            raw = data[at[a] : at[b]]
            try:
                text = raw.decode()
                out.append(text[1:] if text[:1] == " " else text)
            except UnicodeDecodeError:
                out.append(self.library.decode(ids[a:b].tolist()))
        return out


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> PieceVocabulary:
    return PieceVocabulary(path)


def encode_decode(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: ``key``, ``ids`` array<int> of the whole text and ``decoded``, the text of these ids.

    ``path`` is the model file, readable on every executor. No shuffle; one pass over the texts."""
    source = df.select(key, text).toDF("key", "text")
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in chunks(batches, "text", 1 << 20):
            encoded = vocab.encode([t or "" for t in batch.column("text").to_pylist()])
            ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in encoded])])
            ids = np.frombuffer(b"".join(encoded), "<i4")
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), lists, pa.array(vocab.decode(ids, ends), pa.string())], names=[key, "ids", "decoded"])

    return source.mapInArrow(run, schema)
