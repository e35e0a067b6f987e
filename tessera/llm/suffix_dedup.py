"""Repeated byte strings: candidate suffixes of all shards, merged by iterative interleave refinement.

A byte goes if it is covered by a string of LENGTH bytes that starts at another place too.  Sorting every suffix of the
corpus would move every byte LENGTH times, so the work is narrowed in exact steps first:

1. Winnowing: every window of LENGTH bytes has one anchor, the KGRAM bytes with the least hash (the last of equals).  Equal
   windows have equal anchors at the same place, so a window whose anchor occurs once is not repeated.  The windows
   of one anchor occurrence are consecutive starts; their text is the anchor's context.
2. Equal contexts are one; if it occurs twice, all its windows are repeated and no suffix needs ordering.
3. Only anchors with different contexts are left.  Their window suffixes are dealt out by anchor, that is
   by a block of the merged suffix order.  In a block, the suffix lists of all shards are interleaved by
   refinement: at first all are equal (anchor and offset to it); each pass splits blocks by the next eight bytes;
   a block of one suffix is settled and dropped, its depth being the longest common prefix.
   Suffixes still together after LENGTH bytes are the repeated intervals.
4. An anchor with more contexts than fit a task (MOST) has its windows refined at one stroke, by
   counting 128-bit hashes of whole windows over all tasks.

Hashes are 64 bits wide where a later step compares the bytes, 128 bits otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import col, join_groups, release, scratch, small_batches, table
from tessera.llm.minhash import mix64

LENGTH, KGRAM = 200, 64
#: Contexts of one anchor that a task takes (of at most 2 * LENGTH bytes each); the rest is counted by window.
MOST = 4096
#: Window starts of a text taken at a time, and bytes of contexts refined at a time.
SEGMENT, SHARD = 1 << 19, 2 << 20
_BASE = 0x9E3779B97F4A7C15
_LOW = np.uint64((1 << 20) - 1)
_KEY = ["__doc", "__crc"]


class Anchors:
    """Winnowing of byte strings with a rolling hash of KGRAM bytes."""

    def __init__(self, length: int = LENGTH, kgram: int = KGRAM):
        self.length, self.kgram, self.span = length, kgram, length - kgram + 1
        most = SEGMENT + length
        rng = np.random.default_rng(11)
        self.codes = rng.integers(1, 1 << 62, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        inverse = pow(_BASE, -1, 1 << 64)
        one = np.ones(1, dtype=np.uint64)
        self.up = np.cumprod(np.concatenate([one, np.full(most, np.uint64(_BASE))]), dtype=np.uint64)
        self.down = np.cumprod(np.concatenate([one, np.full(most, np.uint64(inverse))]), dtype=np.uint64)

    def hashes(self, data: np.ndarray) -> np.ndarray:
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(self.codes[data] * self.up[:len(data)], dtype=np.uint64)])
        return mix64((sums[self.kgram:] - sums[:-self.kgram]) * self.down[:len(data) - self.kgram + 1])

    def runs(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first start, number of starts, place of the anchor, hash of the anchor) of each run of windows with one anchor."""
        h = self.hashes(data)
        ranked = (h & ~_LOW) | (_LOW - np.arange(len(h), dtype=np.uint64))
        n, t = len(h) - self.span + 1, self.span
        x = np.concatenate([ranked, np.full(-len(h) % t, np.iinfo(np.uint64).max)]).reshape(-1, t)
        before = np.minimum.accumulate(x, axis=1).reshape(-1)
        after = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        least = np.minimum(after[:n], before[t - 1:t - 1 + n])
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        place = (_LOW - (least[first] & _LOW)).astype(np.int64)
        return first, np.diff(np.append(first, n)), place, h[place]


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(__doc, __crc, __text binary); a null id is the smallest number here, a null text is empty."""
    text = F.coalesce(col(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.select(F.coalesce(col(id_col).cast("long"), F.lit(-(1 << 63))).alias("__doc"), F.crc32(text).alias("__crc"), text.alias("__text"))


def anchor_runs(slim: DataFrame, length: int, kgram: int) -> DataFrame:
    """One row per anchor occurrence: anchor, ctx (hash of the context), __doc, __crc, start, n (windows), rel (of the first to the anchor)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        winnow = Anchors(length, kgram)
        out: list[list[np.ndarray]] = [[] for _ in range(7)]
        rows = 0

        def flush() -> pa.RecordBatch:
            arrays = [pa.array(np.concatenate(c)) for c in out]
            for c in out:
                c.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["anchor", "ctx", "__doc", "__crc", "start", "n", "rel"])

        for batch in batches:
            for doc, crc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                whole = np.frombuffer(text.as_buffer(), dtype=np.uint8)
                for at in range(0, len(whole) - length + 1, SEGMENT):
                    data = whole[at:at + SEGMENT + length - 1]
                    first, n, place, h = winnow.runs(data)
                    view = memoryview(data)
                    ctx = np.fromiter((xxhash.xxh64_intdigest(view[a:a + k + length - 1]) for a, k in zip(first.tolist(), n.tolist(), strict=True)),
                                      dtype=np.uint64, count=len(first))
                    values = (h.view(np.int64), ctx.view(np.int64), np.full(len(first), doc, dtype=np.int64), np.full(len(first), crc, dtype=np.int64),
                              (first + at).astype(np.int32), n.astype(np.int32), (first - place).astype(np.int32))
                    for c, v in zip(out, values, strict=True):
                        c.append(v)
                    rows += len(first)
                    if rows >= 50_000:
                        yield flush()
                        rows = 0
        if rows:
            yield flush()

    return slim.mapInArrow(run, "anchor long, ctx long, __doc long, __crc long, start int, n int, rel int")


def refine(contexts: list[bytes], group: np.ndarray, n: np.ndarray, rel: np.ndarray, length: int) -> np.ndarray:
    """Whether each window (n[i] starts in contexts[i], in order) equals another window of its group, by interleave refinement."""
    sizes = np.array([len(c) for c in contexts], dtype=np.int64)
    data = b"".join(contexts) + bytes(16)
    words = np.ndarray(shape=(len(data) - 8,), dtype="<u8", buffer=data, strides=(1,))
    owner = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    at = (np.cumsum(sizes) - sizes)[owner] + inside
    block = mix64(mix64(group[owner].astype(np.uint64)) + (rel[owner] + inside).astype(np.int64).view(np.uint64))
    left = np.arange(len(owner))  # suffixes that aren't settled
    hit = np.zeros(len(owner), dtype=bool)
    depths = [*range(0, length - 7, 8)]
    if depths[-1] + 8 < length:
        depths.append(length - 8)  # the last word overlaps the one before
    for depth in [None, *depths]:
        if depth is not None:
            block = mix64(block * np.uint64(0xD1342543DE82EF95) + words[at + depth])
        order = np.argsort(block)
        b = block[order]
        same = b[1:] == b[:-1]
        twice = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(b) else np.zeros(0, dtype=bool)
        keep = order[twice]  # blocks stay together, so the next pass sorts nearly sorted runs
        left, at, block = left[keep], at[keep], block[keep]
        if not len(left):
            break
    hit[left] = True
    return hit


def hit_runs(hit: np.ndarray, n: np.ndarray) -> list[tuple[int, int, int]]:
    """(context, first window, windows) of each run of hits."""
    owner = np.repeat(np.arange(len(n)), n)
    start = np.flatnonzero(hit & ~(np.concatenate([[False], hit[:-1] & (owner[1:] == owner[:-1])]) if len(hit) else hit))
    stop = np.flatnonzero(hit & ~(np.concatenate([hit[1:] & (owner[1:] == owner[:-1]), [False]]) if len(hit) else hit))
    base = np.cumsum(n) - n
    return [(int(owner[s]), int(s - base[owner[s]]), int(e - s + 1)) for s, e in zip(start, stop, strict=True)]


_CTX = "anchor long, __doc long, __crc long, start int, n int, rel int, m long, text binary"


def context_texts(slim: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The contexts ``wanted`` (anchor, __doc, __crc, start, n, rel, m) with their text."""
    asked = wanted.groupBy(*_KEY).agg(F.collect_list(F.struct("anchor", "start", "n", "rel", "m")).alias("asked"))  # as many as a text has
    rows = slim.join(asked, _KEY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "__doc", "__crc", "start", "n", "rel", "m", "text"]
        for batch in batches:
            for doc, crc, text, asked_ in zip(*(batch.column(i) for i in range(4)), strict=True):
                raw = memoryview(text.as_buffer())
                items = asked_.as_py()
                cols = [[x[k] for x in items] for k in ("anchor", "start", "n", "rel", "m")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array([doc.as_py()] * len(items), pa.int64()), pa.array([crc.as_py()] * len(items), pa.int64()),
                     pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int64()),
                     pa.array([bytes(raw[a:a + k + length - 1]) for a, k in zip(cols[1], cols[2], strict=True)], pa.binary())], names=names)

    return rows.select(*_KEY, "__text", "asked").mapInArrow(run, _CTX)


def refined_ranges(contexts: DataFrame, length: int) -> DataFrame:
    """(__doc, __crc, first, last): bytes of the contexts' repeated windows; anchors have at most MOST contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def close(rows: list[tuple]) -> pa.RecordBatch:
            n = np.array([r[4] for r in rows], dtype=np.int64)
            hit = refine([r[7] for r in rows], np.array([r[0] for r in rows], dtype=np.int64), n, np.array([r[5] for r in rows], dtype=np.int64), length)
            # a context that occurs twice is covered anyway
            found = [(rows[i][1], rows[i][2], rows[i][3] + a, rows[i][3] + a + k + length - 1) for i, a, k in hit_runs(hit, n) if rows[i][6] == 1]
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(4)], names=[*_KEY, "first", "last"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                if size >= SHARD and row[0] != held[-1][0]:
                    yield close(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[7])
        if held:
            yield close(held)

    return contexts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "__doc long, __crc long, first long, last long")


def counted_ranges(contexts: DataFrame, length: int) -> DataFrame:
    """As ``refined_ranges`` for anchors with any number of contexts: windows are counted by their hashes over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                rows = list(zip(*(part.column(k).to_pylist() for k in range(8)), strict=True))
                n = np.array([r[4] for r in rows], dtype=np.int64)
                owner = np.repeat(np.arange(len(n)), n)
                inside = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                digests = [xxhash.xxh128_digest(r[7][a:a + length]) for r in rows for a in range(r[4])]
                pick = lambda k: np.array([r[k] for r in rows], dtype=np.int64)[owner]  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(pick(1)), pa.array(pick(2)), pa.array(pick(3) + inside), pa.array(pick(6))],
                                                 names=["h", *_KEY, "first", "m"])

    windows = scratch(contexts.mapInArrow(run, "h binary, __doc long, __crc long, first long, m long"), "suffix-windows")
    counts = scratch(windows.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "suffix-counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    return join_groups(windows.where("m = 1"), counts, ["h"], "c", total).select(*_KEY, "first", (F.col("first") + length).alias("last"))


def repeated_ranges(slim: DataFrame, length: int = LENGTH, kgram: int = KGRAM, most: int = MOST) -> DataFrame:
    """(__doc, __crc, first, last): byte ranges, first included and last not, whose union is all that is repeated."""
    spark = slim.sparkSession
    runs = scratch(anchor_runs(slim, length, kgram), "suffix-runs")
    anchors = scratch(runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("total"), F.min("ctx").alias("c0"), F.max("ctx").alias("c1"))
                      .where("total > 1").select("anchor", "total", (F.col("c0") != F.col("c1")).alias("mixed")), "suffix-anchors")
    release(spark)
    total = anchors.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    again = scratch(join_groups(runs, anchors, ["anchor"], "total", total).drop("total"), "suffix-again")
    release(spark)
    place = (F.col("__doc").cast("decimal(38,0)") * F.lit(1 << 31).cast("decimal(12,0)") + F.col("start")).cast("decimal(38,0)")
    same = scratch(again.withColumn("place", place).groupBy("anchor", "ctx").agg(
        F.count(F.lit(1)).alias("m"), F.max("mixed").alias("mixed"), F.min("n").alias("n"), F.min("rel").alias("rel"),
        F.min_by("__doc", "place").alias("__doc"), F.min_by("__crc", "place").alias("__crc"), F.min_by("start", "place").alias("start")), "suffix-contexts")
    whole = join_groups(again.drop("mixed"), same.where("m > 1").select("anchor", "ctx", "m"), ["anchor", "ctx"], "m", total).select(
        *_KEY, F.col("start").cast("long").alias("first"), (F.col("start") + F.col("n") + (length - 1)).cast("long").alias("last"))
    mixed = same.where("mixed").select("anchor", *_KEY, "start", "n", "rel", "m")
    texts = scratch(context_texts(slim, mixed, length), "suffix-texts")
    release(spark)
    sizes = texts.groupBy("anchor").agg(F.count(F.lit(1)).alias("k"))
    large = scratch(sizes.where(F.col("k") > most), "suffix-large")
    many = large.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
    small = refined_ranges(texts.join(large, "anchor", "left_anti"), length)
    out = whole.unionByName(small)
    if many:
        out = out.unionByName(counted_ranges(join_groups(texts, large, ["anchor"], "k", many).drop("k"), length))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, kgram: int = KGRAM,
                   most: int = MOST) -> DataFrame:
    """One row per row of ``docs``: doc_id, kept (binary), n_bytes, n_removed, spans array<struct<first, last>>.

    Texts are UTF-8 bytes and strings never cross documents.  What remains may cut a character, hence bytes.  A null or
    short text loses nothing.  A repeated row is another place, so equal rows of ``length`` bytes or more lose everything;
    null ids are documents like any other.  An empty table gives no rows.  Other columns are not read.
    """
    slim = _slim(small_batches(docs), id_col, text_col)
    ranges = scratch(repeated_ranges(slim, length, kgram, most).groupBy(*_KEY).agg(F.collect_set(F.struct("first", "last")).alias("ranges")), "suffix-ranges")
    release(docs.sparkSession)
    rows = slim.join(ranges, _KEY, "left").select("__doc", "__text", "ranges")
    spans = "array<struct<first:long,last:long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        for batch in batches:
            kept, sizes, gone, found = [], [], [], []
            for text, ranges_ in zip(batch.column(1), batch.column(2), strict=True):
                raw, merged = text.as_py(), []
                for a, b in sorted((r["first"], r["last"]) for r in (ranges_.as_py() or [])):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                edges = [0, *[x for r in merged for x in r], len(raw)]
                kept.append(b"".join(raw[edges[i]:edges[i + 1]] for i in range(0, len(edges), 2)))
                sizes.append(len(raw))
                gone.append(len(raw) - len(kept[-1]))
                found.append([{"first": a, "last": b} for a, b in merged])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()),
                                              pa.array(found, kind)], names=["doc_id", "kept", "n_bytes", "n_removed", "spans"])

    out = rows.mapInArrow(run, f"doc_id long, kept binary, n_bytes long, n_removed long, spans {spans}")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id")))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
