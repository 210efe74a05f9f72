"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

Texts become byte-level BPE ids plus one end id. Runs of a full window are cut off first; the rest of
each document is cut into pieces of at most a quarter window, one rest in eight into fine pieces, and
the pieces of a bounded group of windows are partitioned by largest differencing: the two partial
partitions with the largest spread are merged with opposing imbalances until one is left. If a window
then exceeds the capacity, the window count rises and the group is partitioned again.

Ids are those of the tokenizers library with its default flags: the literal of an added token in a text,
such as ``<|endoftext|>``, has that token's own id. Texts that hold one are encoded by the library itself.

Defined results: a null text is an empty text (only the end id); null or repeated ids pass through;
equal rows are packed separately; an empty table gives an empty result; extra columns are ignored.
A very long text is cut like any other; beside the text in hand, memory is bounded by the group (GROUP
windows), not by texts or partitions. Sequence ids come from the partition number and a counter, so a
retried task gives the same ids.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docweave.llm.common import Recent, chunks, keeps, tidy

#: Windows partitioned at once.
GROUP = 64
#: Sequence ids of a partition start at its number shifted by this.
SHIFT = 32

# The pre-tokenizer's pattern of byte-level vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Unicode's White_Space code points, as the tokenizer's \s has them.
_WS = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_UNITS = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, other bytes from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteTokenizer:
    """Ids as the tokenizers library gives them for this vocabulary file. A text is cut into units that the
    pre-tokenizer never crosses; distinct units are merged once, in one call for a batch, and kept in a bounded cache.
    A text with the literal of an added token goes to the library."""

    CACHE = 400_000

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        model = json.loads(Path(path).read_text())
        symbols = byte_symbols()
        added = {t["content"] for t in model.get("added_tokens", ())}
        ranks = {bytes(symbols[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in added}
        self.merges = tiktoken.Encoding("units", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.feed = self.merges.encode_ordinary("\n")[0]
        self.units = Recent(self.CACHE)
        self.library = Tokenizer.from_file(str(path))
        self.added = re.compile("|".join(map(re.escape, sorted(added)))) if added else None

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers."""
        special = {i for i, t in enumerate(texts) if self.added is not None and self.added.search(t)}
        split = [[] if i in special else _UNITS.findall(t) for i, t in enumerate(texts)]
        fresh, spaces = [], []
        for u in self.units.missing(set().union(*split)):
            (spaces if u.isspace() or "\n" in u else fresh).append(u)
        cache = self.units.young
        if fresh:
            # line feeds between units are tokens of their own, whatever stands beside them
            ids = np.array(self.merges.encode_ordinary("\n".join(fresh)), "<u4")
            at = np.concatenate([[-1], np.flatnonzero(ids == self.feed), [len(ids)]])
            if len(at) != len(fresh) + 1:
                raise ValueError("a unit holds a line feed")
            for i, u in enumerate(fresh):
                cache[u] = ids[at[i] + 1 : at[i + 1]].tobytes()
        for u in spaces:
            cache[u] = np.array(self.merges.encode_ordinary(u), "<u4").tobytes()
        out = [b"".join(map(cache.__getitem__, units)) for units in split]
        for i in special:
            out[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, "<u4").tobytes()
        return out


@functools.lru_cache(maxsize=4)
def tokenizer(path: str) -> ByteTokenizer:
    return ByteTokenizer(path)


keeps("packing", tokenizer.cache_clear)


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: indices of ``sizes`` in ``k`` parts of near-equal sums."""
    if not sizes:
        return [[] for _ in range(k)]
    heap = []
    for i, size in enumerate(sizes):
        sums = np.zeros(k, np.int64)
        sums[-1] = size
        heap.append((-size, i, sums, {k - 1: (i,)}))
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        _, _, a, pa_ = heapq.heappop(heap)
        _, _, b, pb = heapq.heappop(heap)
        # a ascending against b descending: the largest of one meets the smallest of the other
        total = a + b[::-1]
        parts = dict(pa_)
        for at, items in pb.items():
            j = k - 1 - at
            parts[j] = (parts[j], items) if j in parts else items
        order = np.argsort(total, kind="stable")
        place = np.empty(k, np.int64)
        place[order] = np.arange(k)
        total = total[order]
        heapq.heappush(heap, (int(total[0] - total[-1]), tick, total - total[0], {int(place[j]): x for j, x in parts.items()}))
        tick += 1
    out: list[list[int]] = [[] for _ in range(k)]
    for j, items in heap[0][3].items():
        stack, found = [items], []
        while stack:
            x = stack.pop()
            stack.extend(x) if isinstance(x, tuple) else found.append(x)
        out[j] = sorted(found)
    return out


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows of at most ``capacity``; their count rises until none exceeds it."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = difference(sizes, k)
        if all(sum(sizes[i] for i in p) <= capacity for p in parts):
            return [p for p in parts if p]
        k += 1


def cuts(n: int, at: int, capacity: int) -> list[int]:
    """Piece lengths of the rest of a document: quarters of a window, and fine pieces in one of eight rests."""
    coarse, fine = max(1, capacity // 4), max(1, capacity // 128)
    step = fine if at % 8 == 0 else coarse
    whole = [coarse] * (n // coarse)
    rest = n - coarse * (n // coarse)
    return whole + [step] * (rest // step) + ([rest % step] if rest % step else [])


def pack(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", capacity: int = 1024, end_id: int = 0) -> DataFrame:
    """Per piece: ``key``, start, length, doc_tokens, sequence_id, offset (long) and tokens, its ids as
    little-endian unsigned 32-bit integers. No shuffle: each partition packs its own documents."""
    source = df.select(key, text).toDF("key", "text")
    longs = [T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")]
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *longs, T.StructField("tokens", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        end = np.array([end_id], "<u4").tobytes()
        base = TaskContext.get().partitionId() << SHIFT
        made = 0
        pending: list[tuple] = []  # key, its ids, start, length, tokens of its document
        waiting = seen = 0
        rows: list[tuple] = []
        key_type = None

        def place(group: list[tuple]) -> None:
            nonlocal made
            for part in windows([p[3] for p in group], capacity):
                offset = 0
                for i in part:
                    k, ids, start, length, total = group[i]
                    rows.append((k, start, length, total, base + made, offset, ids))
                    offset += length
                made += 1

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            types = [key_type, *[pa.int64()] * 5, pa.binary()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=schema.names)
            rows.clear()
            return batch

        for batch in chunks(batches, "text", 1 << 20):
            key_type = batch.schema.field("key").type
            for k, ids in zip(batch.column("key").to_pylist(), tok.encode([t or "" for t in batch.column("text").to_pylist()]), strict=True):
                ids += end
                total = len(ids) // 4
                for start in range(0, total - capacity + 1, capacity):
                    rows.append((k, start, capacity, total, base + made, 0, ids[4 * start : 4 * (start + capacity)]))
                    made += 1
                start = total - total % capacity
                for length in cuts(total - start, seen, capacity):
                    pending.append((k, ids[4 * start : 4 * (start + length)], start, length, total))
                    start += length
                    waiting += length
                seen += 1
                if waiting >= GROUP * capacity:
                    # what exceeds the group by a little slack waits for the next one
                    keep, sized = [], 0
                    most = (GROUP * capacity) - capacity // 8
                    group = []
                    for p in pending:
                        if sized + p[3] <= most:
                            group.append(p)
                            sized += p[3]
                        else:
                            keep.append(p)
                    place(group)
                    pending, waiting = keep, waiting - sized
            if rows:
                yield out()
        if pending:
            place(pending)
            yield out()

    return source.mapInArrow(tidy("packing", run), schema)
