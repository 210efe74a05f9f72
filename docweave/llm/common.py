"""Helpers shared by the operators: table access, the shared folder, vectorised words and hashes."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once in a Python worker; a longer single text is handled alone.
CHUNK_BYTES = 1 << 20
#: Bytes of an Arrow batch on its way to a Python worker, where a table is staged with few at once.
BATCH_BYTES = 4 << 20

#: The white space of the contracts, [\x20\x09-\x0D].
SPACES = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACES)] = True
_rng = np.random.default_rng(20240229)
_BYTE_CODE = _rng.integers(1, 2**63, size=256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session. Where it is unset, a local
    session gets a temporary one; a cluster is refused, as executors would not see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: a cluster needs a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="docweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs meanwhile sends Arrow batches of about BATCH_BYTES: a batch stands in the JVM and in the
    worker at once, and by default holds 10,000 rows of up to 64 MB."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


#: How to let go what an operator keeps in a worker from task to task.
_kept: dict[str, Callable[[], None]] = {}


def keeps(operator: str, let_go: Callable[[], None]) -> None:
    _kept[operator] = let_go


def others_go(operator: str) -> None:
    """Lets go what operators other than this one keep in this process."""
    for name, let_go in _kept.items():
        if name != operator:
            let_go()


@functools.cache
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # other C libraries than glibc
        return None


def trimmed() -> None:
    """Gives the system back what this process has freed; the allocators would keep it while the worker is idle."""
    pa.default_memory_pool().release_unused()
    if (trim := _trim()) is not None:
        trim(0)


def tidy(operator: str, run: Callable) -> Callable:
    """``run``, for mapInArrow, in workers that Spark reuses for other operators: what those keep goes before
    a task, what the task has freed goes after it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        others_go(operator)
        yield from run(batches)
        trimmed()

    return task


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of ``staged`` tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._staged_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, whatever its case rule."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (f"{stem}{k or ''}" for k in range(len(taken) + 1)) if n.lower() not in taken)


def fold(id_col: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string")) % n


def held_out(id_col: str, n: int, remainder: int) -> Column:
    """Whether a row is held out by its id's fold; a row without an id is not."""
    return F.coalesce(fold(id_col, n) == remainder, F.lit(False))


def chunks(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Splits batches so that ``column`` holds about ``most`` bytes at once."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total, begin = np.cumsum(sizes), 0
        if total[-1] <= most:
            yield batch
            continue
        while begin < len(sizes):
            before = total[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, before + most, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column (null: empty) and the n + 1 offsets of its rows in them."""
    column = pc.fill_null(column, "")
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def lowered(buf: np.ndarray) -> np.ndarray:
    """A-Z as a-z; other bytes stay."""
    return np.where((buf >= 65) & (buf <= 90), buf | 32, buf).astype(np.uint8)


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word ``[^\\x20\\x09-\\x0D]+``; words never cross rows."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~IS_SPACE[buf]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = offsets[:-1]
    cuts = cuts[cuts < len(buf)]
    begins[cuts] = inside[cuts]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = offsets[1:]
    last = last[last > 0] - 1
    ends[last] = inside[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(offsets, starts, side="right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, from one polynomial prefix sum over the buffer."""
    n = len(buf)
    if len(_powers[0]) <= n:
        size = n + 1 + (1 << 18)
        for i, base in enumerate((_BASE, _INV)):
            powers = np.full(size, base, np.uint64)
            powers[0] = 1
            _powers[i] = np.multiply.accumulate(powers)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_CODE[buf] * _powers[0][:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _powers[1][starts])


class Recent:
    """Values by key, in two generations of at most about ``most`` keys together: what is still used when the
    younger one is full stays, and only keys unused for a whole generation are lost."""

    def __init__(self, most: int):
        self.most = most
        self.young: dict = {}
        self.old: dict = {}

    def missing(self, keys: set) -> list:
        """The ``keys`` to be put into ``young``; the others are there afterwards."""
        if len(self.young) > self.most // 2:
            self.old, self.young = self.young, {}
        young, old, out = self.young, self.old, []
        for k in keys.difference(young):
            if k in old:
                young[k] = old[k]
            else:
                out.append(k)
        return out


def row_sums(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sum of ``values`` by row number."""
    return np.bincount(rows, weights=values, minlength=n).astype(np.int64)


def shingle_hashes(words: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word shingles within rows, with their rows; position i is words[i : i + width]."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(rows[:n] == rows[width - 1 :])
    total = np.zeros(len(at), np.uint64)
    for k in range(width):
        total = total * _BASE + words[at + k]
    return mix(total), at
