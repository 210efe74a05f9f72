"""N-gram Jaccard join by count vectors in R-trees, with connected components.

A document's set is that of its distinct 5-word shingles (of its whole word sequence with fewer words);
two documents link when their sets' Jaccard similarity reaches 80 %. Documents with equal sets are one
class, and only classes are compared.

*Where pairs meet.* Shingles have one global order: those that many documents share come last, the rest
by how common their words are, rare ones first. Two sets that link share one of the first n - ceil(0.8 n) + 1 shingles of each, so every link
is inside some shingle's group of classes. Most shingles have one class and are dropped at once.

*Stars.* In each group, every class is paired with the group's smallest one, the pair's overlap bound and
overlap are checked, and components are taken. Near copies, however many, thus cost one pair each and key.

*R-trees.* What is left are groups of three or more with several components. First, in
groups over LARGE, each class is paired with its best candidate of another component only, as in
Boruvka's spanning trees, so that large groups grow together by about as many pairs as they have
classes; then all candidates of components that are still apart are checked. Tokens are hashed into DIMS
groups (FINE times as many for sets over LONG) and a set's group counts are a point; a group of classes is packed into an R-tree by size and
coordinates, the overlap of two sets is at most the sum of the coordinate minima, and a search descends from
the root only into boxes whose bound reaches the overlap that a link needs. Pairs of one component need no check.
Groups over BLOCK classes are split into pairs of blocks, so no group is one task's. Surviving pairs are
verified on the sets. No link between components can be lost, so components are exact.

Text passes: one for set sizes, class signatures and frequent shingles, one for the keys, one over the
classes that share a key. The order's tables are bounded: common words are those of at least WORD_SHARE of all
tokens (at most 1 / WORD_SHARE), frequent shingles those in at least HOT_SHARE of the documents (at most
mean set size / HOT_SHARE, held to HOT_MOST). Any fixed order gives the same result; a good one keeps
chance meetings out and groups small.

Defined results: null and empty texts have no shingles and link with nothing; equal rows are one class;
null ids take part but name no component (a component of null ids has a null id); rows that share an id
are judged each by its own text; an empty table gives an empty result; extra columns are ignored; very
long texts are sets like any other. Shingles and classes are identified by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import chunks, free_name, lowered, mix, shingle_hashes, small_batches, span_hashes, staged, text_bytes, tidy, word_spans
from docweave.llm.suffix_lm import summed

#: Words in a shingle; the similarity of a link in hundredths.
WIDTH, PERCENT = 5, 80
#: Coordinates of a count vector, points in a leaf, classes in a block of a split group.
DIMS, LEAF, BLOCK = 256, 16, 1024
#: Sets over this size have FINE times the coordinates: a bound over few coordinates is loose for them.
LONG, FINE = 1024, 8
#: Shingles of at least this share of the documents come last in the order; local counts below HOT_LOCAL are not gathered.
HOT_SHARE, HOT_MOST, HOT_LOCAL, EPOCH = 1e-4, 4_000_000, 4, 3 << 19
#: Words with at least this share of all tokens have a rank above zero in the order.
WORD_SHARE = 1e-5
#: Groups over this take a round of best candidates first.
LARGE = 32
#: Bits of the map that spares texts the way to a join.
MAP_BITS = 1 << 26


def least_overlap(a, b, percent: int = PERCENT):
    """The smallest intersection of linked sets of these sizes: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n, percent: int = PERCENT):
    return n - -(-percent * n // 100) + 1


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the rows, lower-cased, and the row of each."""
    buf, offsets = text_bytes(column)
    buf = lowered(buf)
    starts, ends, rows = word_spans(buf, offsets)
    return span_hashes(buf, starts, ends), rows


def sets_of(words: np.ndarray, rows: np.ndarray, n: int, ranks: np.ndarray | None = None, width: int = WIDTH) -> list:
    """Sorted distinct shingle hashes of each of n rows; with ``ranks`` of the words, pairs of them and their summed ranks."""
    shingles, at = shingle_hashes(words, rows, width)
    cut = np.searchsorted(rows[at], np.arange(n + 1))
    first = np.searchsorted(rows, np.arange(n + 1))
    if ranks is not None:
        sums = np.concatenate([[0], np.cumsum(ranks)])
        summed_ranks = sums[at + width] - sums[at]
    out = []
    for i in range(n):
        found = shingles[cut[i] : cut[i + 1]]
        short = not len(found) and first[i + 1] > first[i]
        if short:
            whole = np.uint64(first[i + 1] - first[i])
            with np.errstate(over="ignore"):
                for w in words[first[i] : first[i + 1]]:
                    whole = whole * np.uint64(0x9E3779B97F4A7C15) + w
            found = mix(np.array([whole], np.uint64))
        if ranks is None:
            out.append(np.unique(found))
        else:
            found, where = np.unique(found, return_index=True)
            out.append((found, np.zeros(1, np.int64) if short else summed_ranks[cut[i] : cut[i + 1]][where]))
    return out


def signature(found: np.ndarray) -> int:
    """A 64-bit hash of a set."""
    total = mix(found ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) ^ mix(np.array([len(found)], np.uint64))[0]
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def vector_of(found: np.ndarray) -> np.ndarray:
    """Count vector: how many shingles are hashed into each of DIMS groups, or of the FINE parts of each for a
    long set. One byte a count where all fit, else four: the value's length tells which."""
    dims = DIMS * FINE if len(found) > LONG else DIMS
    counts = np.bincount((found >> np.uint64(64 - dims.bit_length() + 1)).astype(np.int64), minlength=dims)
    return counts.astype("u1" if counts.max() < 256 else "<i4")


def counts_of(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "u1" if len(raw) in (DIMS, DIMS * FINE) else "<i4").astype(np.int32)


class Points:
    """Count vectors of a column: all with DIMS coordinates, and the fine ones of long sets by row."""

    def __init__(self, column: pa.Array):
        found = [counts_of(r) for r in column.to_pylist()]
        self.fine = {i: v for i, v in enumerate(found) if len(v) > DIMS}
        self.all = np.stack([v if len(v) == DIMS else v.reshape(DIMS, -1).sum(axis=1, dtype=np.int32) for v in found]) if found else np.zeros((0, DIMS), np.int32)

    def finer(self, i: int, other: Points, j: int, need: int) -> bool:
        """Whether the bound by fine coordinates, where both have them, admits the need too."""
        a, b = self.fine.get(i), other.fine.get(j)
        return a is None or b is None or int(np.minimum(a, b).sum()) >= need


def surveyed(df: DataFrame, text: str, key: str) -> DataFrame:
    """One pass: for each row its id, set size n, class, text hash and count vector (kind d); locally frequent shingles (kind h) and words (kind w) with their counts."""
    id_type = df.schema[key].dataType.simpleString()
    names = ["kind", "id", "n", "cls", "th", "vector"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, count, seen, word, times = [], [], set(), [], []

        def frequent() -> Iterator[pa.RecordBatch]:
            for kind, (c, n) in (("h", summed(code, count)), ("w", summed(word, times))):
                often = n >= (HOT_LOCAL if kind == "h" else max(2, WORD_SHARE / 2 * n.sum()))
                c, n = c[often], n[often]
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(c), pa.string()), pa.nulls(len(c), id_arrow), pa.array(n), pa.array(c.view(np.int64)), pa.nulls(len(c), pa.int64()), pa.nulls(len(c), pa.binary())], names=names)
            for held in (code, count, word, times, seen):
                held.clear()

        id_arrow = None
        for batch in chunks(batches, "text"):
            id_arrow = batch.schema.field("id").type
            words, rows = words_of(batch.column("text"))
            sets = sets_of(words, rows, batch.num_rows)
            cls = [signature(s) for s in sets]
            fresh = []
            for c, s in zip(cls, sets, strict=True):
                if c not in seen:
                    seen.add(c)
                    fresh.append(s)
            for of, into, often in ((np.concatenate(fresh or [np.zeros(0, np.uint64)]), code, count), (words, word, times)):
                c, n = np.unique(of, return_counts=True)
                into.append(c)
                often.append(n.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(["d"] * len(cls), pa.string()), batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(cls, pa.int64()), batch.column("th"), pa.array([vector_of(s).tobytes() for s in sets], pa.binary())], names=names)
            if sum(map(len, code)) > EPOCH:
                yield from frequent()
        if id_arrow is not None:
            yield from frequent()

    source = df.select(F.col(key).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("th"))
    return source.mapInArrow(tidy("jaccard_join", run), f"kind string, id {id_type}, n long, cls long, th long, vector binary")


def looked_up(table: tuple[np.ndarray, np.ndarray], codes: np.ndarray) -> np.ndarray:
    """Values of codes in a table of sorted codes and values; 0 for others."""
    if not len(table[0]):
        return np.zeros(len(codes), np.int64)
    at = np.minimum(np.searchsorted(table[0], codes), len(table[0]) - 1)
    return np.where(table[0][at] == codes, table[1][at], 0)


def prefix_keys(df: DataFrame, text: str, order, percent: int = PERCENT) -> DataFrame:
    """(key, cls, n) of the first shingles of each class, once a task. ``order``: broadcast tables of frequent
    shingles with their counts and of common words with their ranks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, common = order.value
        seen: set[int] = set()
        for batch in chunks(batches, "text"):
            keys, cls, size = [], [], []
            words, rows = words_of(batch.column("text"))
            for s, ranks in sets_of(words, rows, batch.num_rows, looked_up(common, words)):
                c = signature(s)
                if not len(s) or c in seen:
                    continue
                seen.add(c)
                n = len(s)
                first = s[np.lexsort((ranks, looked_up(hot, s)))[: prefix_length(n, percent)]]
                keys.append(first)
                cls.append(np.full(len(first), c, np.int64))
                size.append(np.full(len(first), n, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(cls)), pa.array(np.concatenate(size))], names=["key", "cls", "n"])

    return df.select(F.col(text).alias("text")).mapInArrow(tidy("jaccard_join", run), "key long, cls long, n long")


def sorted_table(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Codes in order and their values, of a table of both."""
    code, value = rows.column(0).to_numpy().view(np.uint64), rows.column(1).to_numpy()
    at = np.argsort(code)
    return code[at], value[at]


def grouped(keys: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Groups of two or more classes: kind s (cls with the group's smallest, sizes permitting) and, of three
    or more, kind g (the group's rows). A group passes through as it is sorted; only its first row is held."""
    names = ["kind", "key", "cls", "n", "hub"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of the group that the last batch ended in: key, hub, its size, its last class, rows so far, and its second row
        key = hub = hub_n = last = second = None
        members = 0
        for batch in batches:
            k, c, n = (batch.column(x).to_numpy() for x in ("key", "cls", "n"))
            if not len(k):
                continue
            again = np.zeros(len(k), bool)
            again[1:] = (k[1:] == k[:-1]) & (c[1:] == c[:-1])
            if key is not None:
                again[0] = k[0] == key and c[0] == last
            k, c, n = k[~again], c[~again], n[~again]
            if not len(k):
                continue
            start = np.flatnonzero(np.concatenate([[members == 0 or k[0] != key], k[1:] != k[:-1]]))
            group = np.searchsorted(start, np.arange(len(k)), side="right") - 1  # -1: goes on from before
            place = np.arange(len(k)) - np.where(group >= 0, start[group] if len(start) else 0, -members)
            hubs = np.where(group >= 0, c[start[group]] if len(start) else 0, hub if hub is not None else 0)
            sizes = np.where(group >= 0, n[start[group]] if len(start) else 0, hub_n if hub_n is not None else 0)
            star = (place > 0) & (100 * np.minimum(n, sizes) >= percent * np.maximum(n, sizes))
            out = [("s", k[star], c[star], n[star], hubs[star])]
            # the first two rows of a group are told with its third
            third = np.flatnonzero(place == 2)
            for i in third:
                two = [(hub, hub_n), second] if group[i] < 0 and members >= 2 else [(hub, hub_n), (c[i - 1], n[i - 1])] if group[i] < 0 else [(c[i - 2], n[i - 2]), (c[i - 1], n[i - 1])]
                out.append(("g", np.repeat(k[i], 2), np.array([x[0] for x in two]), np.array([x[1] for x in two]), np.zeros(2, np.int64)))
            more = place >= 2
            out.append(("g", k[more], c[more], n[more], np.zeros(int(more.sum()), np.int64)))
            kinds = np.concatenate([np.repeat(o[0], len(o[1])) for o in out])
            cols = [np.concatenate([np.asarray(o[j], np.int64) for o in out]) for j in range(1, 5)]
            if len(kinds):
                yield pa.RecordBatch.from_arrays([pa.array(kinds.tolist(), pa.string()), *[pa.array(x) for x in cols]], names=names)
            key, last = int(k[-1]), int(c[-1])
            hub, hub_n = int(hubs[-1]), int(sizes[-1])
            if place[-1] == 1:
                second = (int(c[-1]), int(n[-1]))
            members = int(place[-1]) + 1

    return keys.repartition("key").sortWithinPartitions("key", "cls").mapInArrow(tidy("jaccard_join", run), "kind string, key long, cls long, n long, hub long")


def bit_map(wanted: DataFrame):
    """A broadcast map of MAP_BITS bits, whatever the input, with those of the hashes ``th`` set."""
    spark = wanted.sparkSession
    bit = F.pmod(F.col("th"), F.lit(MAP_BITS))
    words = wanted.groupBy(F.shiftright(bit, 5).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(31).cast("int"))).alias("b")).toArrow()
    bits = np.zeros(MAP_BITS // 32, np.uint32)
    bits[words.column(0).to_numpy()] = words.column(1).to_numpy().astype(np.uint32)
    return spark.sparkContext.broadcast(bits)


def mapped(df: DataFrame, th: str, bits, inside: bool) -> DataFrame:
    """Rows whose hash is in the map, or is not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(th).to_numpy() % MAP_BITS
            yield batch.filter(pa.array(((bits.value[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1) == inside))

    return df.mapInArrow(tidy("jaccard_join", run), df.schema)


def held_texts(df: DataFrame, text: str, key: str, wanted: DataFrame) -> DataFrame:
    """Texts of the rows named by ``wanted`` (id, th); rows whose hash is not in the bit map of the wanted
    ones go before the join moves any text."""
    source = df.select(F.col(key).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("th"))
    likely = mapped(source, "th", bit_map(wanted), True)
    wanted = wanted.select(F.col("id").alias("wid"), F.col("th").alias("wth"))
    return likely.join(wanted, F.col("id").eqNullSafe(F.col("wid")) & (F.col("th") == F.col("wth")), "left_semi")


def described(texts: DataFrame) -> DataFrame:
    """(cls, found) of texts: the set as sorted hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            sets = sets_of(*words_of(batch.column("text")), batch.num_rows)
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([signature(s) for s in sets], pa.int64()), found], names=["cls", "found"])

    return texts.select("text").mapInArrow(tidy("jaccard_join", run), "cls long, found array<long>").dropDuplicates(["cls"])


def bounded(pairs: DataFrame, near: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of the pairs (cls, hub) whose sum of coordinate minima admits a link."""
    a = near.select("cls", F.col("vector").alias("va"))
    b = near.select(F.col("cls").alias("hub"), F.col("vector").alias("vb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 512) for b in batches for k in range(0, b.num_rows, 512)):
            va, vb = Points(batch.column("va")), Points(batch.column("vb"))
            need = least_overlap(va.all.sum(axis=1), vb.all.sum(axis=1), percent)
            good = np.minimum(va.all, vb.all).sum(axis=1) >= need
            good = [bool(g) and va.finer(i, vb, i, need[i]) for i, g in enumerate(good)]
            yield batch.select(["cls", "hub"]).filter(pa.array(good, pa.bool_()))

    return pairs.select("cls", "hub").join(a, "cls").join(b, "hub").select("cls", "hub", "va", "vb").mapInArrow(tidy("jaccard_join", run), "cls long, hub long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of the pairs (cls, hub) whose sets link; the sets stay in the JVM, a pair at a time."""
    a = sets.select("cls", F.col("found").alias("fa"))
    b = sets.select(F.col("cls").alias("hub"), F.col("found").alias("fb"))
    shared = F.size(F.array_intersect("fa", "fb"))
    both = pairs.select("cls", "hub").join(a, "cls").join(b, "hub")
    return both.where(100 * shared >= percent * (F.size("fa") + F.size("fb") - shared)).select("cls", "hub")


class RTree:
    """Points packed by size and coordinates under nodes of LEAF children. A node has the box of what lies
    under it: the highest coordinates, the least and the greatest size. ``levels`` go from the points upwards
    until LEAF nodes or fewer are left, which are the root's."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray):
        n = len(sizes)
        slabs = max(1, int(np.sqrt(n / LEAF)))
        order = np.argsort(sizes, kind="stable")
        spread = int(np.argmax(vectors.var(axis=0)))
        slab = np.arange(n) * slabs // n
        self.order = order[np.lexsort((vectors[order, spread], slab))]
        high, least, most = vectors[self.order], sizes[self.order], sizes[self.order]
        self.levels = [(high, least, most)]
        while len(least) > LEAF:
            cuts = np.arange(0, len(least), LEAF)
            high, least, most = np.maximum.reduceat(high, cuts), np.minimum.reduceat(least, cuts), np.maximum.reduceat(most, cuts)
            self.levels.append((high, least, most))

    def search(self, vector: np.ndarray, size: int, percent: int = PERCENT) -> np.ndarray:
        """Points that may overlap enough to link, by descent from the root into the boxes that admit it."""
        lowest = -(-percent * size // 100)
        nodes = np.arange(len(self.levels[-1][1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            high, least, most = self.levels[depth]
            nodes = nodes[(most[nodes] >= lowest) & (percent * least[nodes] <= 100 * size)]
            need = least_overlap(size, np.maximum(least[nodes], lowest), percent)
            nodes = nodes[np.minimum(high[nodes], vector).sum(axis=1) >= need]
            if depth:
                nodes = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
                nodes = nodes[nodes < len(self.levels[depth - 1][1])]
        return self.order[nodes]


def search_all(asking: np.ndarray, sizes: np.ndarray, points: np.ndarray, of: np.ndarray, percent: int = PERCENT) -> list[np.ndarray]:
    """For each asking vector the points that may link with it. A few points are one leaf, compared at once."""
    if len(points) <= 2 * LEAF and len(asking) <= 2 * LEAF:
        bound = np.minimum(asking[:, None, :], points[None, :, :]).sum(axis=2)
        good = bound >= least_overlap(sizes[:, None], of[None, :], percent)
        return [np.flatnonzero(g) for g in good]
    tree = RTree(points, of)
    return [tree.search(v, int(s), percent) for v, s in zip(asking, sizes, strict=True)]


def searched(groups: DataFrame, near: DataFrame, percent: int = PERCENT, best: bool = False) -> DataFrame:
    """Pairs (cls, hub) of different components that the R-trees leave. ``groups``: (key, cls, comp).
    With ``best``, only groups over LARGE, and of each class there the pair with the highest bound for its need."""
    print_of = [F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64("cls", F.lit(7))).alias("y")]
    sizes = groups.groupBy("key").agg(F.count("*").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), *print_of).where("lo < hi")
    # a passage gives many keys the same classes: one of them is enough
    sizes = sizes.groupBy("m", "x", "y").agg(F.min("key").alias("key")).select("key", "m")
    rows = groups.join(sizes.where(F.col("m") > LARGE) if best else sizes, "key")
    # of a group of k blocks, a class goes to the k pairs of blocks that hold its own
    k = F.ceil(F.col("m") / BLOCK).cast("int")
    rows = rows.withColumn("k", k).withColumn("mine", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("k")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    rows = rows.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "cls", "comp").join(near, "cls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, ("key", "i", "j")):
            cls, comp, mine, n = (batch.column(x).to_numpy() for x in ("cls", "comp", "mine", "n"))
            i, j = batch.column("i")[0].as_py(), batch.column("j")[0].as_py()
            points = Points(batch.column("vector"))
            vectors = points.all
            # each class of block i searches the tree of block j
            asking, asked = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
            if not len(asking) or not len(asked):
                continue
            found = search_all(vectors[asking], n[asking], vectors[asked], n[asked], percent)
            left, right = [], []
            for q, hits in zip(asking, found, strict=True):
                hits = asked[hits]
                hits = hits[comp[hits] != comp[q]]
                if q in points.fine:
                    hits = np.array([h for h in hits if points.finer(q, points, h, least_overlap(int(n[h]), int(n[q]), percent))], np.int64)
                if best and len(hits) > 1:
                    spare = np.minimum(vectors[hits], vectors[q]).sum(axis=1) / least_overlap(n[hits], n[q], percent)
                    hits = hits[[np.argmax(spare)]]
                elif i == j and not best:
                    hits = hits[cls[hits] < cls[q]]
                left.append(np.maximum(cls[q], cls[hits]))
                right.append(np.minimum(cls[q], cls[hits]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["cls", "hub"])

    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "cls")
    return dealt.mapInArrow(tidy("jaccard_join", run), "cls long, hub long").distinct()


def whole_groups(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Groups of rows that are sorted by ``by``; each is bounded by the caller."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None and rest.num_rows:
            table = pa.concat_tables([rest, table])
        table = table.combine_chunks()
        if not table.num_rows:
            continue
        cols = [table.column(c).to_numpy() for c in by]
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = np.flatnonzero(new)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield table.slice(a, b - a).combine_chunks().to_batches()[0]
        rest = table.slice(cuts[-1])
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks().to_batches()[0]


def components(edges: DataFrame, a: str = "cls", b: str = "hub") -> DataFrame:
    """(cls, root): the smallest member of each node's component, for nodes with an edge.

    Large-star and small-star rounds on tables in the shared folder; every round's result is a table, so
    lineage stays short. Ends when a round changes nothing."""
    now = staged(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    print_of = lambda d: tuple(d.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())
    before = print_of(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = staged(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
        after = print_of(now)
        if after == before:
            break
        before = after
    return now.groupBy(F.col("u").alias("cls")).agg(F.min("v").alias("root")).unionByName(now.select(F.col("v").alias("cls"), F.col("v").alias("root")).distinct())


def join(df: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """Per row ``key``, th (xxhash64 of the text), n_shingles, cls (class), root (component's smallest class)
    and component_id, the smallest id of the component; a row without shingles is its own component."""
    spark = df.sparkSession
    with small_batches(spark):
        survey = staged(surveyed(df, text, key), "jaccard-survey")
    members = survey.where("kind = 'd'").select("id", "n", "cls", "th")
    full = members.where("n > 0")
    total, shingles = full.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    share = max(HOT_SHARE, shingles / max(1, total) / HOT_MOST)
    counts = survey.where("kind <> 'd'").groupBy("kind", "cls").agg(F.sum("n").alias("n"))
    hot = counts.where((F.col("kind") == "h") & (F.col("n") >= max(2 * HOT_LOCAL, share * total))).select("cls", "n")
    least = max(2.0, WORD_SHARE * shingles)
    common = counts.where((F.col("kind") == "w") & (F.col("n") >= least)).select("cls", F.round(1 + 16 * F.log2(F.col("n") / least)).cast("long").alias("n"))
    order = spark.sparkContext.broadcast((sorted_table(hot.toArrow()), sorted_table(common.toArrow())))

    with small_batches(spark):
        groups = staged(grouped(prefix_keys(df, text, order, percent), percent), "jaccard-groups")
    stars = groups.where("kind = 's'").select("cls", "hub").distinct()
    runs = groups.where("kind = 'g'").select("key", "cls")
    classes = full.groupBy("cls").agg(F.min(F.struct("id", "th")).alias("first"), F.min("id").alias("least"))
    wanted = groups.where("kind = 's'").select(F.explode(F.array("cls", "hub")).alias("cls")).union(runs.select("cls")).distinct()
    points = survey.where("kind = 'd' and n > 0").select("cls", "n", "vector")
    near = staged(points.join(wanted, "cls", "left_semi").dropDuplicates(["cls"]), "jaccard-near")

    def linked_of(left: DataFrame) -> DataFrame:
        with small_batches(spark):
            left = staged(left, "jaccard-pairs")
        named = left.select(F.explode(F.array("cls", "hub")).alias("cls")).distinct().join(classes, "cls").select("first.id", "first.th")
        with small_batches(spark):
            sets = staged(described(held_texts(df, text, key, named)), "jaccard-sets")
        return staged(verified(left, sets, percent), "jaccard-links")

    links = linked_of(bounded(stars, near, percent))
    roots = components(links)
    for best in (True, False):
        placed = runs.join(roots, "cls", "left").select("key", "cls", F.coalesce("root", "cls").alias("comp"))
        more = linked_of(searched(placed, near, percent, best))
        if more.limit(1).count():
            links = links.unionByName(more)
            roots = components(links)

    rooted = classes.join(roots, "cls", "left").select("cls", "least", F.coalesce("root", "cls").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = rooted.join(named, "root").select("cls", "root", "component_id")
    linked = full.join(of_class, "cls").select(F.col("id").alias(key), "th", F.col("n").alias("n_shingles"), "cls", "root", "component_id")
    alone = members.where("n = 0").select(F.col("id").alias(key), "th", F.col("n").alias("n_shingles"), "cls", F.lit(None).cast("long").alias("root"), F.col("id").alias("component_id"))
    return linked.unionByName(alone)


def first_of_each(df: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """``df`` with one row of each component: that of the smallest (id, text hash). Rows without shingles
    all stay; rows that repeat both id and text are one. Only rows whose hash is in the bit map of those
    that may go are moved; the others pass straight through."""
    rows = staged(join(df, text, key, percent).select(F.col(key).alias("id"), "th", "root"), "jaccard-rows")
    linked = rows.where("root is not null").groupBy("root").agg(F.min(F.struct("id", "th")).alias("f")).select("f.id", "f.th")
    firsts = linked.union(rows.where("root is null").select("id", "th")).withColumn("first", F.lit(1))
    each = rows.select("id", "th", F.lit(0).alias("first")).union(firsts).groupBy("id", "th").agg(F.max("first").alias("first"), (F.count("*") - F.sum("first")).alias("n"))
    unsure = staged(each.where("first = 0 or n > 1"), "jaccard-unsure")
    bits = bit_map(unsure)
    th, gone_id, gone_th = (free_name(df, x) for x in ("th_", "gone_id_", "gone_th_"))
    source = df.withColumn(th, F.xxhash64(text))
    moved = mapped(source, th, bits, True)
    gone = unsure.where("first = 0").select(F.col("id").alias(gone_id), F.col("th").alias(gone_th))
    stays = moved.join(gone, F.col(key).eqNullSafe(F.col(gone_id)) & (F.col(th) == F.col(gone_th)), "left_anti").dropDuplicates([key, th])
    return mapped(source, th, bits, False).unionByName(stays).drop(th)
