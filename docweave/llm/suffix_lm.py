"""Language-model scoring with a probabilistic suffix tree.

A text is the sequence of its lower-cased (A-Z) words and one end; written out, each word is its bytes
and a blank, the end a line feed, so that a probability of the byte sequence is one of the tokens.
The tree's contexts are byte strings of up to DEPTH symbols. Candidates are those seen LEAST_COUNT times,
whatever the corpus size; one is retained if the divergence of its next-symbol distribution from that of its
longest suffix, weighted by its count, passes LEAST_GAIN nats. Distributions are smoothed towards the
suffix's by the number of distinct symbols seen (Witten-Bell). A symbol's probability is that of the longest
retained suffix of what was read. A text's score is the sum of its symbols' log10 probabilities, so long words
have no floor; it is a proper distribution over all texts, unlike the base score, which gives each of the
endless unseen words a share of 1 / (N + V + 1) and can therefore be the higher one for texts with many.

The tree grows with the corpus and is never whole anywhere. All contexts that share their last SHORT symbols
depend on each other and on a table of the contexts of up to SHORT symbols alone, so that runs of DEPTH + 1
symbols are dealt into buckets by these. One pass over the texts files, by bucket, the counts of training runs
and the distinct runs of each block of texts; a bucket adds its counts up, evaluates its part of the tree and
answers each block with the probabilities of its runs, in their order; words and their counts go the same way.
Blocks and answers meet by the block's number. A bucket has BUCKET symbols in a small corpus; beyond BUCKETS
buckets they grow up to LARGEST symbols first, then in number, as every block files a row in every bucket. A bucket
reads these rows one by one. Suffixes that are much commoner than a bucket is large are dealt by one more symbol.

Blocks are numbered twice, when runs are filed and when they are scored, by the order of rows and the sizes of
texts alone: an input whose rows could come in another order when a task runs again (after an exchange) is
written to the shared folder first.

Defined results: a null text is an empty one (only the end); repeated rows score alike and count each
in training; null ids are not held out; an empty training set gives uniform symbols; an empty table
gives an empty result; extra columns are ignored. Words are identified by 64-bit hashes; a symbol's logarithm
is exact to a part in 100,000 and equal for equal runs. Memory is bounded by
a block of texts or one long text, by a bucket's distinct runs and by its compressed rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docweave.llm.common import IS_SPACE, chunks, dropped, free_name, lowered, mix, span_hashes, staged, text_bytes, word_spans

DEPTH, SHORT = 6, 3
#: Nats that a context must save, and how often it must occur.
LEAST_GAIN, LEAST_COUNT = 4.0, 4
BLANK, END = 0x20, 0x0A
#: The hash that stands for the end token among words.
END_WORD = np.uint64(0x454E44)
#: Bytes of text in a block; entries that a task gathers before it adds equal ones up; bytes of text worked on at once.
BLOCK, GATHER, PIECE = 3 << 20, 4 << 20, 1 << 20
#: Symbols in a bucket at least and at most, and buckets up to which the least is kept.
BUCKET, LARGEST, BUCKETS = 8 << 20, 64 << 20, 96
#: Bytes that a row counts in a block beside its text, so that empty texts fill blocks too.
ROW = 32


def spelled(buf: np.ndarray, offsets: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray, tuple]:
    """The symbols of all rows, each row as ``pad`` line feeds, its words with blanks, and the end; where
    each row begins in them; and the word spans."""
    n = len(offsets) - 1
    room = offsets + np.arange(n + 1) * (pad + 2)  # each row gets its feeds, a blank after its last word, and the end
    out = np.full(room[-1], BLANK, np.uint8)
    for i in range(n):
        out[room[i] + pad : room[i + 1] - 2] = buf[offsets[i] : offsets[i + 1]]
    space = IS_SPACE[out]
    kept = ~space
    kept[1:] |= ~space[:-1]
    out[space] = BLANK
    for i in range(pad):
        out[room[:-1] + i] = END
        kept[room[:-1] + i] = True
    out[room[1:] - 1] = END
    kept[room[1:] - 1] = True
    sizes = np.add.reduceat(kept, room[:-1], dtype=np.int64) if n else np.zeros(0, np.int64)
    return out[kept], np.concatenate([[0], np.cumsum(sizes)]), word_spans(buf, offsets)


def summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes with their added counts."""
    if not codes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    code, count = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(code)
    code, count = code[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    return code[first], np.add.reduceat(count, first) if len(first) else count


def runs(symbols: np.ndarray, begins: np.ndarray, depth: int) -> np.ndarray:
    """Codes of every scored symbol with its ``depth`` predecessors, as big-endian numbers."""
    n = len(symbols) - depth
    code = np.zeros(max(0, n), np.uint64)
    for k in range(depth + 1):
        code = (code << np.uint64(8)) | symbols[k : k + n]
    scored = np.ones(len(symbols), bool)
    scored[(begins[:-1, None] + np.arange(depth)[None, :]).ravel()] = False
    return code[scored[depth:]]


def unique(codes: np.ndarray) -> np.ndarray:
    """Sorted distinct codes; by sorting, which is faster for numbers than hashing them."""
    codes = np.sort(codes)
    return codes[np.concatenate([[True], codes[1:] != codes[:-1]])] if len(codes) else codes


def merged(parts: Iterator[np.ndarray]) -> np.ndarray:
    """Sorted distinct codes of all parts, of which GATHER, or twice the distinct ones so far, are held at once."""
    held, size, most = [], 0, GATHER
    for part in parts:
        held.append(part)
        size += len(part)
        if size > most:
            held = [unique(np.concatenate(held))]
            size = len(held[0])
            most = max(GATHER, 2 * size)
    return unique(np.concatenate(held)) if held else np.zeros(0, np.uint64)


def low(codes: np.ndarray, symbols: int) -> np.ndarray:
    """The last ``symbols`` symbols of codes."""
    return codes & np.uint64((1 << (8 * symbols)) - 1)


def levels(codes: np.ndarray, n: np.ndarray, p: np.ndarray, v: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted distinct runs of ``most`` + 1 symbols with their counts: the smoothed probability after the
    context of ``most`` symbols, and that after its longest retained suffix. ``p``, ``v``: the same for contexts of
    ``least`` symbols. The runs must be all there are of every context."""
    for d in range(least + 1, most + 1):
        code, first, where = np.unique(low(codes, d + 1), return_index=True, return_inverse=True)
        if not len(code):
            break
        count = np.bincount(where, weights=n, minlength=len(code))
        above, shorter = p[first], v[first]
        cut = np.flatnonzero(np.concatenate([[True], (code[1:] >> np.uint64(8)) != (code[:-1] >> np.uint64(8))]))
        many = np.diff(np.append(cut, len(code)))
        size = np.repeat(np.add.reduceat(count, cut), many)
        kinds = np.repeat(np.add.reduceat((count > 0).astype(float), cut), many)
        seen = size >= LEAST_COUNT
        with np.errstate(divide="ignore", invalid="ignore"):
            own = np.where(seen, (count + kinds * above) / (size + kinds), above)
            gain = np.where(count > 0, count * np.log(count / size / above), 0.0)
        retained = seen & (np.repeat(np.add.reduceat(gain, cut), many) >= LEAST_GAIN)
        p, v = own[where], np.where(retained, own, shorter)[where]
    return p, v


def tallied(df: DataFrame, training: Column, text: str) -> DataFrame:
    """Counts (code, n) of runs of SHORT + 1 symbols in training texts; zero for those of other texts only. The
    code -1 has the number of symbols of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, symbols_ = [], [], 0
        for batch in chunks(batches, "text", PIECE):
            symbols, begins, _ = spelled(*_lower(batch.column("text")), SHORT)
            found = runs(symbols, begins, SHORT).astype(np.uint32)
            symbols_ += len(found)
            trains = np.repeat(batch.column("trains").to_numpy(zero_copy_only=False), np.diff(begins) - SHORT)
            for some, counting in ((found[trains], 1), (found[~trains], 0)):
                code, n = np.unique(some, return_counts=True)
                held.append(code.astype(np.uint64))
                counts.append(n.astype(np.int64) * counting)
            if sum(map(len, held)) > GATHER:
                code, n = summed(held, counts)
                held, counts = [code], [n]
        code, n = summed(held, counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(code.astype(np.int64), -1)), pa.array(np.append(n, symbols_))], names=["code", "n"])

    parts = df.select(F.col(text).alias("text"), training.alias("trains")).mapInArrow(run, "code long, n long")
    return parts.groupBy("code").agg(F.sum("n").alias("n"))


def _lower(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    buf, offsets = text_bytes(column)
    return lowered(buf), offsets


class Root:
    """Distributions after no and after one symbol, from the counts of pairs: bounded by the bytes."""

    def __init__(self, pairs: dict[int, int]):
        count = np.zeros((256, 256))
        for code, n in pairs.items():
            count[code >> 8, code & 255] = n
        total = count.sum()
        p = (count.sum(axis=0) + 1) / (total + 256)
        codes = np.arange(1 << 16, dtype=np.uint64)
        self.p, self.v = levels(codes, count.ravel(), np.tile(p, 256), np.tile(p, 256), 0, 1)


class Buckets:
    """How runs and words are dealt: runs by the last SHORT symbols of their context, those that are hot by one more."""

    def __init__(self, n: int, hot: np.ndarray):
        self.n, self.hot = n, np.sort(hot)

    def of_runs(self, codes: np.ndarray) -> np.ndarray:
        suffix = low(codes >> np.uint64(8), SHORT)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, suffix), len(self.hot) - 1)
            suffix = np.where(self.hot[at] == suffix, low(codes >> np.uint64(8), SHORT + 1) + np.uint64(1 << 40), suffix)
        return (mix(suffix) % np.uint64(self.n)).astype(np.int64)

    def of_words(self, hashes: np.ndarray) -> np.ndarray:
        return (mix(hashes) % np.uint64(self.n)).astype(np.int64)

    def all_of(self, code: int) -> np.ndarray:
        """The buckets in which the context of a run of SHORT + 1 symbols is needed."""
        return np.unique(self.of_runs(np.uint64(code) | (np.arange(256, dtype=np.uint64) << np.uint64(8 * (SHORT + 1)))))


def bucket_size(symbols: int) -> int:
    """Symbols in a bucket of a corpus. Rows of blocks and buckets are as many as blocks times buckets."""
    return max(BUCKET, min(LARGEST, -(-symbols // BUCKETS)))


def turned(codes: np.ndarray) -> np.ndarray:
    """Codes with the symbols that a bucket's runs share in front, so that sorted ones are near each other."""
    older = codes >> np.uint64(8 * (SHORT + 1))
    return low(codes, SHORT + 1) << np.uint64(32) | older


def back(keys: np.ndarray) -> np.ndarray:
    return (keys & np.uint64(0xFFFFFFFF)) << np.uint64(8 * (SHORT + 1)) | keys >> np.uint64(32)


def packed(values: np.ndarray) -> bytes:
    """An array compressed, bytes of one place together."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes())


def unpacked(raw: bytes, kind: str) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(width, -1).T).view(kind).ravel()


def ordered(keys: np.ndarray) -> bytes:
    """Sorted keys, as packed differences."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def keys_of(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw, "<u8"), dtype=np.uint64)


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with the places that have it, in their order."""
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1]])) if len(bucket) else np.zeros(0, np.int64)
    for a, b in zip(cut, np.append(cut[1:], len(bucket)), strict=True):
        yield int(bucket[order[a]]), order[a:b]


# kinds of what is filed in a bucket: counts of runs and words (c, w), needs of a block (r, x), contexts of SHORT symbols (u)
_FILED = "bucket long, kind string, block long, codes binary, numbers binary"


def _filed(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "kind", "block", "codes", "numbers"])


def contexts(short: DataFrame, root, buckets) -> DataFrame:
    """The evaluated contexts of up to SHORT symbols, filed where the longer ones need them."""
    last = F.shiftright("code", 8).bitwiseAND(F.lit(255).cast("long"))

    def evaluated(codes: np.ndarray, n: np.ndarray) -> list[tuple]:
        order = np.argsort(codes)
        codes, n = codes[order], n[order].astype(float)
        pair = low(codes, 2).astype(np.int64)
        p, v = levels(codes, n, root.value.p[pair], root.value.v[pair], 1, SHORT)
        b = buckets.value
        suffix = codes >> np.uint64(8)
        hot = np.isin(suffix, b.hot)
        where = [(k, at) for k, at in by_bucket(b.of_runs(codes[~hot]))]
        cool = np.flatnonzero(~hot)
        filed: dict[int, list[np.ndarray]] = {k: [cool[at]] for k, at in where}
        for s in np.unique(suffix[hot]):
            mine = np.flatnonzero(suffix == s)
            for k in b.all_of(int(s) << 8):
                filed.setdefault(int(k), []).append(mine)
        rows = []
        for k, parts in filed.items():
            at = np.sort(np.concatenate(parts))
            rows.append((k, "u", 0, ordered(codes[at]), packed(np.concatenate([p[at], v[at]]))))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            yield _filed(evaluated(batch.column("code").to_numpy().astype(np.uint64), batch.column("n").to_numpy()))

    return short.repartition(last).sortWithinPartitions(last).mapInArrow(run, _FILED)


def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by the symbol before their last, all of one symbol at once: of at most 256 ** SHORT runs each."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        table = table.combine_chunks()
        of = (table.column("code").to_numpy() >> 8) & 255
        cut = int(np.searchsorted(of, of[-1])) if len(of) else 0
        for part in table.slice(0, cut).combine_chunks().to_batches():
            yield part
        rest = table.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks().to_batches()[0]


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows with the number of the block of about BLOCK bytes that they are in: by the sizes of the texts before them
    in the partition alone, as Arrow batches end by the bytes of all columns, which differ from one pass to the other."""
    base, before = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + ROW
        total = before + np.cumsum(sizes)
        number = (total - sizes) // BLOCK
        for number_, at in by_bucket(number):
            yield base + number_, batch.slice(at[0], len(at))
        before = int(total[-1])


def distinct(column: pa.Array, depth: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """The distinct runs, in turned order, and words of texts, with their counts."""
    buf, offsets = _lower(column)
    symbols, begins, spans = spelled(buf, offsets, depth)
    return np.unique(turned(runs(symbols, begins, depth)), return_counts=True), np.unique(span_hashes(buf, *spans[:2]), return_counts=True)


def filed(df: DataFrame, text: str, training: Column, buckets, depth: int) -> DataFrame:
    """By bucket: counts of training runs and words, as far as a task could add them up, and the needs of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = buckets.value
        held: dict[str, tuple[list, list]] = {"c": ([], []), "w": ([], [])}
        deal = {"c": lambda k: b.of_runs(back(k)), "w": b.of_words, "r": lambda k: b.of_runs(back(k)), "x": b.of_words}

        def emit(kind: str) -> Iterator[pa.RecordBatch]:
            code, n = summed(*held[kind])
            held[kind] = ([], [])
            rows = [(k, kind, 0, ordered(code[at]), packed(n[at].astype("<u4") if n.max() < 1 << 32 else n[at])) for k, at in by_bucket(deal[kind](code))]
            if rows:
                yield _filed(rows)

        def needs(block: int, parts: dict[str, list]) -> pa.RecordBatch:
            return _filed([(k, kind, block, ordered(code[at]), None) for kind in "rx" for code in [unique(np.concatenate(parts[kind]))] for k, at in by_bucket(deal[kind](code))])

        now, parts = None, {"r": [], "x": []}
        for block, batch in numbered(batches):
            if now is not None and block != now:
                yield needs(now, parts)
                parts = {"r": [], "x": []}
            now = block
            for piece in chunks(iter([batch]), "text", PIECE):
                trained = piece.column("trains")
                for part, counting in ((piece.filter(trained), True), (piece.filter(pc.invert(trained)), False)):
                    if not part.num_rows:
                        continue
                    (code, n), (words, times) = distinct(part.column("text"), depth)
                    parts["r"].append(code)
                    parts["x"].append(words)
                    if not counting:
                        continue
                    for kind, c, often in (("c", code, n), ("w", np.append(words, END_WORD), np.append(times, part.num_rows))):
                        held[kind][0].append(c)
                        held[kind][1].append(often.astype(np.int64))
                        if sum(map(len, held[kind][0])) > GATHER:
                            c, often = summed(*held[kind])
                            held[kind] = ([c], [often])
                            if len(c) > GATHER // 2:
                                yield from emit(kind)
        if now is not None:
            yield needs(now, parts)
        for kind in held:
            if held[kind][0]:
                yield from emit(kind)

    return df.select(F.col(text).alias("text"), training.alias("trains")).mapInArrow(run, _FILED)


def answered(rows: DataFrame, depth: int) -> DataFrame:
    """Per bucket the answers to its blocks: log10 probabilities of their runs, counts of their words; and, as
    block -1, how many tokens, distinct ones and ends there were in training."""
    schema = "block long, bucket long, run boolean, tokens long, kinds long, ends long, numbers binary"
    arrow_schema = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("run", pa.bool_()), ("tokens", pa.int64()), ("kinds", pa.int64()), ("ends", pa.int64()), ("numbers", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        of: dict[str, list] = {k: [] for k in "cwrxu"}
        for kind, block, codes, numbers in zip(*[table.column(c).to_pylist() for c in ("kind", "block", "codes", "numbers")], strict=True):
            of[kind].append((block, codes, numbers))
        out = []

        def added(kind: str) -> tuple[np.ndarray, np.ndarray]:
            codes, counts, most = [], [], GATHER
            for _, raw, numbers in of[kind]:
                codes.append(keys_of(raw))
                flat = zstandard.ZstdDecompressor().decompress(numbers)
                counts.append(unpacked(numbers, "<u4" if len(flat) == 4 * len(codes[-1]) else "<i8").astype(np.int64))
                if sum(map(len, codes)) > most:
                    code, n = summed(codes, counts)
                    codes, counts, most = [code], [n], max(GATHER, 2 * len(code))
            return summed(codes, counts)

        words, times = added("w")
        end = times[words == END_WORD]
        out.append((-1, bucket, False, int(times.sum()), len(words), int(end.sum()), b""))
        for block, raw, _ in of["x"]:
            out.append((block, bucket, False, 0, 0, 0, packed(looked_up((words, times), keys_of(raw), 0).astype("<i8"))))
        if of["r"]:
            needed = merged(keys_of(raw) for _, raw, _ in of["r"])
            codes = np.sort(back(needed))
            key, n = added("c")
            count = looked_up((key, n), turned(codes), 0)
            upper = [(keys_of(raw), unpacked(numbers, "<f8")) for _, raw, numbers in of["u"]]
            up = np.concatenate([k for k, _ in upper])
            order = np.argsort(up)
            p, v = (np.concatenate([x[: len(k)] if first else x[len(k) :] for k, x in upper])[order] for first in (True, False))
            at, there = places(up[order], low(codes, SHORT + 1))
            if not there.all():
                raise ValueError("a context without its suffix")
            _, v = levels(codes, count, p[at], v[at], SHORT, depth)
            # 16 bits after the point of a 32-bit float
            logs = (-np.log10(v)[np.argsort(turned(codes), kind="stable")]).astype("<f4")
            logs = (logs.view("<u4") + np.uint32(64)) >> np.uint32(7)
            for block, raw, _ in of["r"]:
                out.append((block, bucket, True, 0, 0, 0, packed(logs[np.searchsorted(needed, keys_of(raw))])))
        pa.default_memory_pool().release_unused()
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow_schema.types, strict=True)], schema=arrow_schema)

    return rows.groupBy("bucket").applyInArrow(run, schema)


def places(table: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``codes`` are in the sorted ``table``, and whether they are."""
    if not len(table):
        return np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
    at = np.minimum(np.searchsorted(table, codes), len(table) - 1)
    return at, table[at] == codes


def looked_up(table: tuple[np.ndarray, np.ndarray], codes: np.ndarray, missing: float) -> np.ndarray:
    """The values of ``codes`` in a table of sorted codes and values."""
    at, there = places(table[0], codes)
    out = np.full(len(codes), missing, np.float64)
    out[there] = table[1][at[there]]
    return out


def settled(df: DataFrame) -> DataFrame:
    """``df``, written out if its rows could come in another order in a second evaluation."""
    return staged(df, "lm-input") if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df


def blocks(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` and the text, with the number of the row's block."""
    schema = T.StructType([T.StructField("block", T.LongType()), *[df.schema[c] for c in keep], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in numbered(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, number)), *batch.columns], names=schema.names)

    return df.select(*keep, F.col(text).alias("text")).mapInArrow(run, schema)


def score(df: DataFrame, training: Column, text: str = "text", keep: tuple[str, ...] = ("doc_id",), depth: int = DEPTH) -> DataFrame:
    """``keep`` with n_tokens, n_known, train_tokens, base_score and score; the model and the counts come
    from the rows for which ``training`` holds."""
    kept = list(keep)
    context = df.sparkSession.sparkContext
    trains = free_name(df, "trains_")
    df = settled(df.select(*dict.fromkeys([*kept, text]), F.coalesce(training, F.lit(False)).alias(trains)))
    tally = staged(tallied(df, F.col(trains), text), "lm-short")
    symbols = (tally.where("code = -1").first() or (0, 0))[1] or 0
    short = tally.where("code <> -1")
    pair = F.col("code").bitwiseAND(F.lit(0xFFFF).cast("long"))
    # at most 65,536 pairs, and suffixes of which each has a quarter of a bucket or more
    root = context.broadcast(Root({r[0]: r[1] for r in short.groupBy(pair.alias("pair")).agg(F.sum("n")).collect()}))
    size = bucket_size(symbols)
    many = max(1, -(-symbols // size))
    hot = short.groupBy(F.shiftright("code", 8).alias("suffix")).agg(F.sum("n").alias("n")).where(F.col("n") > size // 4).select("suffix").toArrow() if many > 1 else None
    buckets = context.broadcast(Buckets(many, hot.column(0).to_numpy().astype(np.uint64) if hot is not None else np.zeros(0, np.uint64)))
    rows = filed(df, text, F.col(trains), buckets, depth).unionByName(contexts(short, root, buckets))
    found = staged(answered(rows, depth), "lm-answers")
    tokens, kinds, ends = found.where("block = -1").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "kinds", "ends")]).first()
    norm = math.log10(tokens + kinds + 1)

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())]
    schema = T.StructType([*[df.schema[c] for c in kept], *fields])
    arrow_schema = to_arrow_schema(schema)

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        parts = []
        for batch in chunks(iter(texts.combine_chunks().to_batches()), "text", PIECE):
            buf, offsets = _lower(batch.column("text"))
            symbols_, begins, (starts, ends_, owner) = spelled(buf, offsets, depth)
            code = turned(runs(symbols_, begins, depth))
            order = np.argsort(code)
            code = code[order]
            first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            # a row's runs: those of its symbols but for the feeds in front
            of_row = np.repeat(np.arange(batch.num_rows, dtype=np.int32), np.diff(begins) - depth)[order]
            parts.append((batch, code[first], np.diff(np.append(first, len(code))), of_row, span_hashes(buf, starts, ends_), owner))
        keys, words = unique(np.concatenate([x[1] for x in parts])), unique(np.concatenate([x[4] for x in parts]))
        logs, times = np.full(len(keys), np.nan), np.zeros(len(words), np.int64)
        answer = {(run_, k): raw for run_, k, raw in zip(*[answers.column(c).to_pylist() for c in ("run", "bucket", "numbers")], strict=True)}
        for k, at in by_bucket(buckets.value.of_runs(back(keys))):
            logs[at] = -(unpacked(answer[True, k], "<u4") << np.uint32(7)).view("<f4")
        for k, at in by_bucket(buckets.value.of_words(words)):
            times[at] = unpacked(answer[False, k], "<i8")
        out = []
        for batch, code, often, of_row, hashes, owner in parts:
            size = batch.num_rows
            n_tokens = np.bincount(owner, minlength=size).astype(np.int64) + 1
            # every row's words, then its end
            row = np.repeat(np.arange(size), n_tokens)
            count = np.full(len(row), ends, np.int64)
            count[np.arange(len(owner)) + owner] = times[np.searchsorted(words, hashes)]
            value = np.repeat(logs[np.searchsorted(keys, code)], often)
            sums = [np.bincount(row, weights=x, minlength=size) for x in (count > 0, np.log10(count + 1.0) - norm)]
            sums.append(np.bincount(of_row, weights=value, minlength=size))
            cols = [pa.array(n_tokens), pa.array(sums[0].astype(np.int64)), pa.array(np.full(size, tokens, np.int64)), pa.array(sums[1]), pa.array(sums[2])]
            out.append(pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], *cols], schema=arrow_schema))
        pa.default_memory_pool().release_unused()
        return pa.Table.from_batches(out, schema=arrow_schema)

    dropped(tally)
    return blocks(df, text, kept).groupBy("block").cogroup(found.where("block >= 0").select("block", "bucket", "run", "numbers").groupBy("block")).applyInArrow(run, schema)
