"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, union-find.

An element of a document's shingle set brings one pseudo-random permutation of the signature's places and one
uniform number per rank; place p takes the smallest (rank + number) over all elements.  Ranks are dealt out
one after the other for the whole set, and once every place holds a value below the next rank, nothing later can lower it: long
documents stop after a rank or two.  Places of one element never share a rank, hence the lower variance.

Equal sets are one class from the start.  Bands of the signature give buckets.  First every member of a bucket meets only the
bucket's leader, which settles groups of copies at one pair a member.  Buckets that still span several components are
searched inside their tasks, in blocks of bounded size: members of different components that share NEED bands are compared on
their sets, each pair in the first band it shares, and only links that join two components leave the task.
All links are confirmed on the full sets of 64-bit shingle hashes; components are found by union-find.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.llm.common import col, discard, join_groups, keep_ids, release, scratch, small_batches, table

SHINGLE, PERCENT = 5, 75
#: Signature places in bands of 4; of the 48 bands, a pair of similarity 0.75 shares fewer than NEED with probability 3e-7.
PLACES, BAND_ROWS, NEED = 192, 4, 2
#: Bands a member shares with its bucket's leader before their sets are fetched (others are left to the search in blocks).
NEED_LEADER = 6
#: Members of a block of a bucket; pairs that share one copy of a leader's set.
BLOCK, PAIRS = 1024, 2048
#: Bit tables of 32768 ids each that are looked up before texts are shuffled.
FILTER_PARTS = 1024
_GOLDEN, _MASK, _K = 0x9E3779B97F4A7C15, (1 << 64) - 1, np.uint64(0xD1342543DE82EF95)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash, remembered for up to ``most`` words at a time (results don't depend on it)."""

    def __init__(self, most: int = 100_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def shingle_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's five-word shingles (A-Z lower-cased); of the whole sequence if it is shorter."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=n)
    k = min(n, SHINGLE)
    s = np.full(n - k + 1, np.uint64(k))
    for i in range(k):
        s = mix64(s * _K + h[i:n - k + 1 + i])
    return np.unique(s)


def super_minhash(sets: list[np.ndarray], places: int = PLACES) -> np.ndarray:
    """SuperMinHash signatures, one row per non-empty set; a value is rank * 2^32 + 32 random bits."""
    sig = np.full((len(sets), places), np.iinfo(np.uint64).max, dtype=np.uint64)
    if not sets:
        return sig
    element = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    perm, flat = None, sig.reshape(-1)
    for rank in range(places):
        draw = mix64(element + np.uint64((rank + 1) * _GOLDEN & _MASK))
        swap = rank + (((draw >> np.uint64(32)) * np.uint64(places - rank)) >> np.uint64(32)).astype(np.int64)
        value = (np.uint64(rank) << np.uint64(32)) | (draw & np.uint64(0xFFFFFFFF))
        if rank == 0:
            place, first = swap, swap
        else:
            rows = np.arange(len(element))
            place = perm[rows, swap].astype(np.int64)
            perm[rows, swap] = perm[:, rank]
        np.minimum.at(flat, owner * places + place, value)
        if rank + 1 == places:
            break
        open_ = sig.max(axis=1) >= (np.uint64(rank + 1) << np.uint64(32))
        left = open_[owner]
        if not left.any():
            break
        if rank == 0:
            element, owner, first = element[left], owner[left], first[left]
            perm = np.broadcast_to(np.arange(places, dtype=np.uint16), (len(element), places)).copy()
            perm[np.arange(len(element)), first] = 0
        elif left.sum() < 0.7 * len(left):
            element, owner, perm = element[left], owner[left], perm[left]
    return sig


def band_keys(sig: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of the key."""
    bands = sig.reshape(len(sig), -1, rows)
    key = np.broadcast_to(np.arange(1, bands.shape[1] + 1, dtype=np.uint64), bands.shape[:2]).copy()
    for i in range(rows):
        key = mix64(key * _K + bands[:, :, i])
    return key.view(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch], elements: int = 30_000):
    """(ids, sets) of a bounded number of elements at a time."""
    hashes = WordHashes()
    ids, sets, n = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            sets.append(shingle_set(text.as_py(), hashes))
            ids.append(doc)
            n += len(sets[-1])
            if n >= elements or len(ids) >= 2000:
                yield ids, sets
                ids, sets, n = [], [], 0
    if ids:
        yield ids, sets


def set_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", places: int = PLACES) -> DataFrame:
    """(doc_id, n_shingles, set_hash, bands): size, 128-bit hash and band keys of every document's shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _chunks(batches):
            full = [i for i, s in enumerate(sets) if len(s)]
            keys = band_keys(super_minhash([sets[i] for i in full], places))
            bands: list = [None] * len(sets)
            for i, row in zip(full, keys, strict=True):
                bands[i] = row
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                 pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_hash", "bands"])

    return docs.select(col(id_col).cast("long"), col(text_col).cast("string")).mapInArrow(
        run, "doc_id long, n_shingles long, set_hash binary, bands array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """(rep, elements): the whole shingle set of each document (doc_id, text) as sorted 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                                             names=["rep", "elements"])

    return docs.mapInArrow(run, "rep long, elements binary")


def token_sets(docs: DataFrame, kind: str = "<u4") -> DataFrame:
    """(rep, tokens): as ``full_sets``, by default with 32-bit hashes (repeated ones kept, so sizes are exact)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([s.astype(kind).tobytes() for s in sets], pa.binary())],
                                             names=["rep", "tokens"])

    return docs.mapInArrow(run, "rep long, tokens binary")


def texts_of(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """One row of ``docs`` (doc_id, text) per id of ``needed`` (doc_id).

    Before texts are shuffled, a bit table of the ids (FILTER_PARTS * 4 kB, whatever the input) lets through the needed ones and, by chance, some
    others; the join that follows is exact."""
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_PARTS * 32768)) + 1
    part, at = F.bitmap_bucket_number(spot), F.bitmap_bit_position(spot)
    bits = needed.groupBy(part.alias("part")).agg(F.bitmap_construct_agg(at).alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    likely = docs.withColumns({"part": part, "at": at}).join(F.broadcast(bits), "part").where(F.getbit(byte, F.col("at") % 8) == 1)
    # an inner join: a semi join would be pushed below the bit table, and all texts shuffled
    return likely.select("doc_id", "text").join(needed.distinct(), "doc_id").dropDuplicates(["doc_id"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows of ``pairs`` (a, b) whose sets meet 100 * intersection >= percent * union.

    ``a`` may be hot and its set large: its pairs are salted over as many shares as hold PAIRS of them, and its set goes to each share."""
    total = pairs.count()
    sizes = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    shares = F.ceil(F.col("n") / PAIRS).cast("int")
    salted = join_groups(pairs, sizes, ["a"], "n", total).select("a", "b", F.pmod(F.xxhash64("b"), shares).cast("int").alias("salt"))
    right = salted.join(sets.select(F.col("rep").alias("b"), F.col("elements").alias("eb")), "b")
    left = sizes.join(sets.select(F.col("rep").alias("a"), F.col("elements").alias("ea")), "a")
    left = left.select("a", "ea", F.explode(F.sequence(F.lit(0), shares - 1)).alias("salt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = []
            for ea, eb in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(ea.as_buffer(), dtype=np.uint64), np.frombuffer(eb.as_buffer(), dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                hit.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(hit, pa.bool_()))

    return right.join(left, ["a", "salt"]).select("a", "b", "ea", "eb").mapInArrow(run, "a long, b long")


def _forest(edges: DataFrame) -> DataFrame:
    """The same components with fewer edges: union-find over the edges of each task, as (node, root) pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            top = x
            while root.get(top, top) != top:
                top = root[top]
            while root.get(x, x) != top:
                root[x], x = top, root[x]
            return top

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ru, rv = find(u), find(v)
                if ru != rv:
                    root[max(ru, rv)] = min(ru, rv)
        nodes = list(root)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["u", "v"])

    return edges.mapInArrow(run, "u long, v long").where("u <> v")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step over (u, v) with u > v; keeps components, moves edges to smaller nodes."""
    total = 2 * edges.count() if large else edges.count()
    around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = around.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.least(F.min("v"), F.first("u")).alias("m"))
    moved = join_groups(around, least, ["u"], "n", total)
    if large:
        new = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        new = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return new.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest reachable node for every node of ``edges`` (u, v) that isn't itself the smallest.

    Alternates large-star and small-star steps until nothing moves; every step's table is written to the shared folder."""
    edges = scratch(_forest(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))).distinct(), "edges")
    seen = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = mark
        edges = scratch(_star(scratch(_star(edges, True), "edges"), False), "edges")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT,
                    places: int = PLACES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Null and blank texts have an empty set and are linked with nothing.  Repeated rows have equal sets, so
    they share a component.  A row with a null id takes the component of its equals, or null, and is kept only if
    no row with an id stands for it.  An empty table gives no rows.  Other columns are not read.
    """
    wide = scratch(set_features(small_batches(docs), id_col, text_col, places), "near-features")
    feats = scratch(wide.drop("bands"), "near-documents")
    classes = scratch(wide.where("n_shingles > 0").groupBy("set_hash").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"), F.first("n_shingles").alias("size")), "near-classes")
    discard(wide)
    slim = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    comps = link_components(classes.where("rep is not null"), slim, percent)
    placed = classes.join(comps, classes["rep"] == comps["node"], "left").select(
        "set_hash", "n", F.coalesce("component", "rep").alias("component_id"))
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    full = join_groups(feats.where("n_shingles > 0"), placed, ["set_hash"], "n", total)
    alone = feats.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.select("doc_id", "n_shingles", "component_id").unionByName(alone).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def star_pairs(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): every member with the leader of its bucket, if they share NEED_LEADER bands."""
    pairs = rows.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    total = pairs.count()
    right = pairs.join(classes.select(F.col("rep").alias("b"), F.col("bands").alias("bb")), "b")
    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    left = counts.join(classes.select(F.col("rep").alias("a"), F.col("bands").alias("ba")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (batch.column(i).flatten().to_numpy().reshape(batch.num_rows, -1) for i in (2, 3))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= NEED_LEADER))

    return join_groups(right, left, ["a"], "n", total).select("a", "b", "ba", "bb").mapInArrow(run, "a long, b long")


def block_partners(comp: np.ndarray, side: np.ndarray, bands: np.ndarray, n: np.ndarray, key: int, percent: int,
                   need: int = NEED) -> Iterator[tuple[int, np.ndarray]]:
    """(i, later members it has to be compared with) among the members of one block pair of the bucket ``key``.

    They belong to different components, their sizes allow the similarity, they share ``need`` bands and this is the first of
    them.  ``side`` is 0 or 1 by the block a member comes from: members of one block meet in the block's pair with itself, where all have side 0."""
    two = side.any()
    for i in range(len(n)):
        later = np.arange(i + 1, len(n))
        later = later[(comp[later] != comp[i]) & (100 * n[later] >= percent * n[i]) & (100 * n[i] >= percent * n[later])]
        if two:
            later = later[side[later] != side[i]]
        if len(later):
            shared = bands[later] == bands[i]
            first = bands[i][shared.argmax(axis=1)]
            later = later[(shared.sum(axis=1) >= need) & (first == key)]
            if len(later):
                yield i, later


def block_links(rep: np.ndarray, comp: np.ndarray, side: np.ndarray, bands: np.ndarray, sets: list[np.ndarray], key: int, percent: int,
                need: int = NEED) -> list[tuple[int, int]]:
    """Links that join components, among the members of one block pair of the bucket ``key``.

    With 32-bit hashes in the sets a shared hash may be a coincidence, and a pair that passes by one hides later pairs of the same
    components; ``link_components`` finds these when the pair fails the exact check."""
    n = np.array([len(s) for s in sets])
    starts = np.cumsum(n) - n
    tokens, ids = np.unique(np.concatenate(sets), return_inverse=True)
    mark, root, found = np.zeros(len(tokens), dtype=np.int32), {}, []

    def find(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    for i, later in block_partners(comp, side, bands, n, key, percent, need):
        own = ids[starts[i]:starts[i] + n[i]]
        mark[own] = 1
        if len(later) > len(rep) // 8:
            both = np.add.reduceat(mark[ids], starts)[later]
        else:
            both = np.array([mark[ids[starts[j]:starts[j] + n[j]]].sum() for j in later])
        mark[own] = 0
        for j in later[100 * both >= percent * (n[i] + n[later] - both)]:
            a, b = find(int(comp[i])), find(int(comp[j]))
            if a != b:
                root[max(a, b)] = min(a, b)
                found.append((int(rep[i]), int(rep[j])))
    return found


def _by_block(live: DataFrame, columns: list[str], work, schema: str) -> DataFrame:
    """Apply ``work`` to the rows of every block pair (bucket, x, y) that has two components; it gets a list of rows, sorted by rep,
    (bucket, rep, comp, side, bands, *columns) and returns a list of tuples for ``schema``."""
    names = ["bucket", "x", "y", "rep", "comp", "side", "bands", *columns]
    fields = StructType.fromDDL(schema).fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at = None

        def close() -> list[tuple]:
            return work(held) if len({r[2] for r in held}) > 1 else []

        def frame(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(len(fields))], names=fields)

        for batch in batches:
            out: list[tuple] = []
            if batch.num_rows:
                bands = batch.column(6).flatten().to_numpy().reshape(batch.num_rows, -1)
            for k, row in enumerate(zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 3, 4, 5, *range(7, len(names)))), strict=True)):
                if row[:3] != at:
                    out += close()
                    held, at = [], row[:3]
                held.append((row[0], *row[3:6], bands[k].copy(), *row[6:]))
            if out:
                yield frame(out)
        out = close()
        if out:
            yield frame(out)

    dealt = live.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", "rep")
    return dealt.select(*names).mapInArrow(run, schema)


def _arrays(rows: list[tuple]) -> tuple[np.ndarray, ...]:
    return tuple(np.array([r[i] for r in rows]) for i in (1, 2, 3, 4))


def bucket_partners(live: DataFrame, percent: int) -> DataFrame:
    """(bucket, x, y, rep): the rows of ``live`` (bucket, x, y, side, rep, comp, bands, size) that have anyone to be compared with."""

    def work(rows: list[tuple]) -> list[tuple]:
        rep, comp, side, bands = _arrays(rows)
        met = np.zeros(len(rows), dtype=bool)
        for i, later in block_partners(comp, side, bands, np.array([r[5] for r in rows]), rows[0][0], percent):
            met[i] = met[later] = True
        return [(rows[0][0], *rows[0][6:8], int(r)) for r in rep[met]]

    return _by_block(live.withColumns({"bx": F.col("x"), "by": F.col("y")}), ["size", "bx", "by"], work, "bucket long, x long, y long, rep long")


def bucket_links(live: DataFrame, percent: int, kind: str = "<u4") -> DataFrame:
    """(a, b): candidate links between components.  ``live``: bucket, x, y, side, rep, comp, bands, tokens (hashes of type ``kind``)."""

    def work(rows: list[tuple]) -> list[tuple]:
        return block_links(*_arrays(rows), [np.frombuffer(r[5], dtype=kind) for r in rows], rows[0][0], percent)

    return _by_block(live, ["tokens"], work, "a long, b long")


def link_components(classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """(node, component) over the classes' representatives.  ``classes``: rep, size, bands; ``docs``: doc_id, text."""
    members = classes.select("rep", F.explode("bands").alias("bucket"))
    buckets = scratch(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("leader")).where("n > 1"), "near-buckets")
    total = buckets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = scratch(join_groups(members, buckets, ["bucket"], "n", total), "near-members")
    release(classes.sparkSession)

    def links_of(pairs: DataFrame) -> tuple[DataFrame, int]:
        """The pairs that are links, and the number of those that are not."""
        pairs = scratch(pairs, "near-pairs")
        needed = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
        sets = scratch(full_sets(texts_of(docs, needed)), "near-sets")
        release(docs.sparkSession)  # the shuffled texts
        found = scratch(verified(pairs, sets, percent).select(F.col("a").alias("u"), F.col("b").alias("v")), "near-links")
        discard(sets)
        return found, pairs.count() - found.count()

    def searched(comps: DataFrame, kind: str) -> DataFrame:
        """Candidate links between the components that still share a bucket, from sets of hashes of type ``kind``."""
        labelled = rows.join(comps, rows["rep"] == comps["node"], "left").select("bucket", "rep", "n", F.coalesce("component", "rep").alias("comp"))
        labelled = scratch(labelled, "near-labelled")
        # only pairs of different components count, so the members of a bucket's largest one (main) meet the others alone
        sizes = labelled.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("c"))
        spans = sizes.groupBy("bucket").agg(F.sum("c").alias("n"), F.max("c").alias("in_main"), F.max_by("comp", "c").alias("main"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
        live = join_groups(labelled.drop("n"), spans, ["bucket"], "n", total)
        is_main, others = F.col("comp") == F.col("main"), F.ceil((F.col("n") - F.col("in_main")) / BLOCK).cast("long")
        mains = F.ceil(F.col("in_main") / BLOCK).cast("long")
        live = live.withColumn("own", F.when(is_main, others + F.pmod(F.xxhash64("rep"), mains)).otherwise(F.pmod(F.xxhash64("rep"), others)))
        live = live.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(is_main, others).otherwise(others + mains) - 1))).select(
            "bucket", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).cast("int").alias("side"), "rep", "comp")
        live = scratch(live, "near-live")
        seen = scratch(bucket_partners(live.join(classes.select("rep", "bands", "size"), "rep"), percent), "near-partners")
        release(classes.sparkSession)
        needed = scratch(seen.select(F.col("rep").alias("doc_id")).distinct(), "near-needed")
        tokens = scratch(token_sets(texts_of(docs, needed), kind), "near-tokens")
        release(classes.sparkSession)  # the shuffled texts
        live = live.join(seen, ["bucket", "x", "y", "rep"], "left_semi").join(classes.select("rep", "bands"), "rep").join(tokens, "rep")
        return bucket_links(live, percent, kind).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    links, _ = links_of(star_pairs(rows, classes))
    comps = components(links)
    release(classes.sparkSession)
    more, failed = links_of(searched(comps, "<u4"))
    links = links.unionByName(more)
    comps = components(links)
    release(classes.sparkSession)
    if failed:  # a pair passed on coincidences and may have hidden others: once more with whole hashes, which the check uses too
        more, _ = links_of(searched(comps, "<u8"))
        comps = components(links.unionByName(more))
    return comps


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **args) -> DataFrame:
    """One row of each near-duplicate group of ``docs``: the one with the smallest id, all columns."""
    return keep_ids(docs, id_col, near_duplicates(docs, id_col, text_col, **args).where("kept"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
