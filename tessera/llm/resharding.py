"""Resharding at least cost: old shard sizes and new capacities make a transport problem, whose flow says which bytes move where.

Three steps.  One pass writes a slim row per document (size, checksum, old shard, position).  The documents so large that cutting the
stream of a shard between them would leave shards uneven (their number is bounded by arithmetic) are dealt out one by one, staying
where they are if they fit; then successive shortest paths solve the flow of all other bytes from old shards to what is left of
the new capacities.  The driver only sees shard totals, those few documents and the flow.  Last, running sums of bytes within
(old shard, part) cut every old shard into the blocks of the flow.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.common import col, discard, remainder_of_id, scratch, table, whole_row

#: Shards before and after in the registered query, and bytes that a row counts beside its text.
OLD_SHARDS, NEW_SHARDS, ROW_BYTES = 32, 40, 16
#: A document above 1 / FINE of a new shard is dealt out alone; there are at most FINE documents a shard of these.
FINE, MOST_SHARDS = 512, 4096


def min_cost_flow(supply: list[int], demand: list[int], cost: np.ndarray) -> np.ndarray:
    """The flow (sources x sinks, whole numbers) that meets ``demand`` from ``supply`` at least ``cost``; sums must be equal.

    Successive shortest paths: each round finds the cheapest way from a source with supply left to a sink with demand left, over
    unused arcs and back over used ones, and fills it.  Matrices are shards by shards, whatever the data."""
    left, room = np.array(supply, dtype=np.int64), np.array(demand, dtype=np.int64)
    if left.sum() != room.sum():
        raise ValueError("supply and demand differ")
    cost = np.asarray(cost, dtype=np.float64)
    flow = np.zeros(cost.shape, dtype=np.int64)
    while left.sum():
        to_source = np.where(left > 0, 0.0, np.inf)
        to_sink = np.full(len(room), np.inf)
        from_source, from_sink = np.full(len(room), -1), np.full(len(left), -1)
        while True:
            ways = to_source[:, None] + cost
            best = ways.argmin(axis=0)
            new = ways[best, np.arange(len(room))]
            better = new < to_sink - 1e-9
            to_sink[better], from_source[better] = new[better], best[better]
            back = np.where(flow > 0, to_sink[None, :] - cost, np.inf)
            best = back.argmin(axis=1)
            new = back[np.arange(len(left)), best]
            again = new < to_source - 1e-9
            to_source[again], from_sink[again] = new[again], best[again]
            if not again.any():
                break
        sink = int(np.where(room > 0, to_sink, np.inf).argmin())
        path, much, j = [], int(room[sink]), sink
        while True:
            i = int(from_source[j])
            path.append((i, j, 1))
            if from_sink[i] < 0:
                much = min(much, int(left[i]))
                break
            j = int(from_sink[i])
            path.append((i, j, -1))
            much = min(much, int(flow[i, j]))
        for a, b, sign in path:
            flow[a, b] += sign * much
        left[path[-1][0]] -= much
        room[sink] -= much
    return flow


def levels(loads: list[int], total: int) -> list[int]:
    """How much of ``total`` every shard takes so that loads become as equal as can be."""
    order = np.argsort(loads, kind="stable")
    held = np.array(loads, dtype=np.int64)[order]
    below = np.cumsum(held)
    for k in range(len(held), 0, -1):
        level, spare = divmod(int(total + below[k - 1]), k)
        if level >= held[k - 1]:
            break
    take = [0] * len(loads)
    for at in range(k):
        take[order[at]] = level - int(held[at]) + (at < spare)
    return take


def deal_large(large: list[tuple[int, int, int]], shards: int, fair: int) -> tuple[dict[int, int], list[int]]:
    """({position: shard}, loads): documents (position, size, old shard), largest first, stay while their shard has room below
    ``fair``, else go to the shard with the smallest load."""
    loads = [0] * shards
    heap, where = [(0, j) for j in range(shards)], {}
    for at, size, old in large:
        j = old
        if not (0 <= old < shards and loads[old] + size <= fair):
            while heap[0][0] != loads[heap[0][1]]:
                heapq.heappop(heap)
            j = heap[0][1]
        where[at] = j
        loads[j] += size
        heapq.heappush(heap, (loads[j], j))
    return where, loads


def slim_rows(docs: DataFrame, old: Column, id_col: str = "doc_id", text_col: str = "text", *carry: Column) -> DataFrame:
    """(at, doc_id, size, text_crc32, old_shard, carry...): one row per document; ``at`` is its position, kept by writing it."""
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    return scratch(docs.select(F.monotonically_increasing_id().alias("at"), col(id_col).alias("doc_id"),
                               (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                               F.coalesce(old.cast("long"), F.lit(-1)).alias("old_shard"), *carry), "reshard-rows")


def assign_shards(rows: DataFrame, shards: int, cost: np.ndarray | None = None) -> DataFrame:
    """``rows`` (of ``slim_rows``) with shard and slot, the row's place in its shard, gapless from 0.

    ``cost`` (old shards in ascending order x new shards) is the price of a byte's way; by default 0 to the shard of the same number and 1 to any other."""
    spark = rows.sparkSession
    totals = sorted((r.old_shard, r.b) for r in rows.groupBy("old_shard").agg(F.sum("size").alias("b")).limit(MOST_SHARDS + 1).collect())
    if len(totals) > MOST_SHARDS:
        raise ValueError(f"more than {MOST_SHARDS} old shards")
    total = sum(b for _, b in totals)
    fine = max(8, FINE * NEW_SHARDS // max(shards, NEW_SHARDS))
    is_large = F.col("size") * F.lit(shards * fine) > F.lit(total)  # fewer than shards * fine rows, whatever the table
    large = [tuple(r) for r in rows.where(is_large).orderBy(F.desc("size"), "doc_id", "at").select("at", "size", "old_shard").collect()]
    where, loads = deal_large(large, shards, -(-total // shards))
    supply = dict(totals)
    for _, size, old in large:
        supply[old] -= size
    olds = [old for old, _ in totals]
    price = np.array([[float(i != j) for j in range(shards)] for i in olds]).reshape(len(olds), shards) if cost is None else cost
    rest = [supply[i] for i in olds]
    flow = min_cost_flow(rest, levels(loads, sum(rest)), price) if olds else np.zeros((0, shards), dtype=np.int64)
    cuts = []
    for i, old in enumerate(olds):
        to = sorted(np.flatnonzero(flow[i]).tolist(), key=lambda j, old=old: (j != old, j)) or [0]  # what stays comes first
        ends = np.cumsum(flow[i][to])[:-1].tolist()
        cuts.append((old, ends, to))
    plan = spark.createDataFrame(cuts, "old_shard long, ends array<long>, to array<int>")  # as many numbers as the flow has arcs
    alone = spark.createDataFrame(list(where.items()), "at long, shard int")  # the large documents

    part = F.shiftright("at", 33)
    small = rows.where(~is_large).withColumn("part", part)
    run = W.partitionBy("old_shard", "part").orderBy("at")
    small = small.withColumn("upto", F.sum("size").over(run))
    base = rows.where(~is_large).groupBy("old_shard", part.alias("part")).agg(F.sum("size").alias("b"))
    base = base.select("old_shard", "part", (F.sum("b").over(W.partitionBy("old_shard").orderBy("part")) - F.col("b")).alias("base"))
    small = small.join(base, ["old_shard", "part"]).join(F.broadcast(plan), "old_shard")
    middle = F.col("base") + F.col("upto") - F.col("size") / 2
    small = small.withColumn("shard", F.element_at("to", F.size(F.filter("ends", lambda e: e <= middle)) + 1))
    placed = small.select(*rows.columns, "shard", "part", F.row_number().over(W.partitionBy("old_shard", "part", "shard").orderBy("at")).alias("k"))
    big = rows.where(is_large).join(F.broadcast(alone), "at").withColumn("part", F.lit(-1).cast("long"))
    big = big.select(*rows.columns, "shard", "part", F.row_number().over(W.partitionBy("old_shard", "shard").orderBy("at")).alias("k"))
    placed = scratch(placed.unionByName(big), "reshard-placed")
    pieces = placed.groupBy("shard", "old_shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("shard").orderBy("part", "old_shard")) - F.col("n")
    pieces = pieces.select("shard", "old_shard", "part", before.alias("before"))
    return placed.join(pieces, ["shard", "old_shard", "part"]).select(*rows.columns, "shard", (F.col("before") + F.col("k") - 1).cast("long").alias("slot"))


def reshard(docs: DataFrame, old: Column, shards: int, id_col: str = "doc_id", text_col: str = "text", cost: np.ndarray | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, old_shard, shard, slot.

    Shards become equal in bytes but for the last document at each cut, and but for documents larger than a shard.  A null text has no
    bytes beside ROW_BYTES; a row whose ``old`` is null has no shard yet and counts as moved; shard numbers from
    ``shards`` on are dissolved.  Repeated rows and null ids are rows like others.  An empty table gives no rows.  Other columns are not read.
    """
    return assign_shards(slim_rows(docs, old, id_col, text_col), shards, cost).drop("at")


def rewrite_shards(spark: SparkSession, path: str, shards: int, id_col: str = "doc_id", text_col: str = "text", shard_col: str = "shard") -> DataFrame:
    """Reshard the Parquet table at ``path``, a folder per shard (``<shard_col>=<number>``), in place; (old_shard, shard, rows, bytes) that moved.

    Only folders that lose or gain rows are written anew.  The rows are copied to the shared folder first, so a run that breaks off
    while folders are replaced loses none."""
    docs = spark.read.parquet(path)
    rows = slim_rows(docs, col(shard_col), id_col, text_col, whole_row(docs, (shard_col,)).alias("row"))
    told = scratch(assign_shards(rows.drop("row"), shards), "reshard-told")
    moves = scratch(told.where("old_shard <> shard").groupBy("old_shard", "shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes")), "reshard-moves")
    pairs = [(r.old_shard, r.shard) for r in moves.collect()]  # at most old shards x new shards
    touched = {j for pair in pairs for j in pair}
    if touched:
        out = rows.select("at", "row").join(told.where(F.col("shard").isin(*touched)).select("at", "shard", "slot"), "at")
        out = out.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot")
        out = out.select("row.*", F.col("shard").alias(shard_col))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(shard_col).parquet(path)
        kept = {r.shard for r in told.select("shard").distinct().collect()}
        for j in sorted(touched - kept):
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{shard_col}={'__HIVE_DEFAULT_PARTITION__' if j < 0 else j}")
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    discard(rows)
    return moves


def transfers(moved: DataFrame) -> dict[int, dict[int, int]]:
    """{old shard: {new shard: bytes}} of a result of ``reshard``: as many numbers as there are pairs of shards."""
    out: dict[int, dict[int, int]] = defaultdict(dict)
    for r in moved.groupBy("old_shard", "shard").agg(F.sum("size").alias("b")).collect():
        out[r.old_shard][r.shard] = r.b
    return dict(out)


def op12_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 32 shards by the id's checksum to 40 shards of equal bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = reshard(docs, remainder_of_id(F.col("doc_id"), OLD_SHARDS), NEW_SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")
