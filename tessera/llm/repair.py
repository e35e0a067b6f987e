"""Conversation structure repair: the cheapest edits that give every conversation the roles (s?(ua)+)?, by a checkpointed dynamic program.

A conversation of T rows is cut into blocks of about the square root of T rows.  Backwards, only the state-cost vectors at the
blocks' ends are kept: a block acts on such a vector as a small matrix, and the matrices of a conversation are multiplied from
its end.  Forwards, every block is computed again from the vector at its end, and emits the ASCII-least edits that are
tight, i.e. lose nothing against the least cost; which state a block begins in follows from the blocks before it.  Blocks
are independent rows, so a conversation of any length is spread over the tasks, and what meets in one place is one record a block.

States: 0 nothing yet, 1 after a system row, 2 after a user row, 3 after an assistant row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.common import WORD_CHAR, col, discard, join_groups, scratch, small_batches, table

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Rows of a block: the square root of the conversation's rows, LEAST_BLOCK at least.
LEAST_BLOCK = 64
INF = 1 << 60
#: States that a row of the role may follow and the state after it.
AFTER = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: Row symbols: initial (x: any other role) of a sound row, its upper case for a truncated one, a digit for one to delete.
SOUND, CUT, GONE = "suax", "SUAX", "0123"
NAMES = {"u": "user", "a": "assistant"}


def damage(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) of ``turns`` after damage by crc32(conv_id:turn) mod 20: 0 drops a row, 1 empties its text, 2 takes
    its full stops, exclamation and question marks, 3 repeats it, 4 makes its role user.  Nulls are one space."""
    told = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    rows = turns.select(col(conv).alias("conv_id"), col(turn).alias("turn"), told(col(role)).alias("role"), told(col(text)).alias("text"),
                        (F.crc32(F.concat(told(col(conv)), F.lit(":"), told(col(turn))).cast("binary")) % 20).alias("kind"))
    rows = rows.where("kind <> 0").withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    changed = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"))


def ordered_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, key, g, role, text), (key, g, turn, pos, count, fault, symbol)) of ``rows`` (conv_id, turn, role, text).

    ``key`` is the conversation, never null, ``g`` a number that grows with the order, ``pos`` the place in the conversation (from 0), ``count`` its
    rows, ``fault`` blank, duplicate, truncated or null.  Rows are taken by turn, nulls first, ties by role and text.

    Sorted as a whole in ranges, so that a long conversation lies in many parts; positions come from counts per part."""
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    rows = scratch(rows.withColumn("key", key).withColumn("at", F.monotonically_increasing_id()), "repair-damaged")
    order = ["key", "turn", "role", "text", "at"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    same = F.unhex(F.md5(F.concat("role", F.lit("\0"), "text").cast("binary")))
    last = F.regexp_extract("text", f"({WORD_CHAR})[\\x20\\x09-\\x0D]*$", 1)
    placed = scratch(placed.select("conv_id", "key", "turn", "role", "text", F.monotonically_increasing_id().alias("g"), same.alias("same"), last.alias("last")), "repair-sorted")
    discard(rows)

    slim = placed.select("key", "turn", "g", F.shiftright("g", 33).alias("part"), "same", "last", F.substring("role", 1, 1).alias("initial"))
    counts = scratch(slim.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n")), "repair-parts")
    whole = W.partitionBy("key")
    counts = counts.select("key", "part", (F.sum("n").over(whole.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(whole).alias("count"))
    slim = slim.withColumn("k", F.row_number().over(W.partitionBy("key", "part").orderBy("g")))
    slim = slim.join(counts, ["key", "part"])
    firsts = placed.groupBy("key", "same").agg(F.min("g").alias("first"), F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.coalesce(F.sum(F.when(F.col("before") == 0, F.col("count"))), F.lit(0))).first()[0]
    slim = join_groups(slim, firsts, ["key", "same"], "n", total)
    fault = F.when(F.col("last") == "", "blank").when(F.col("first") < F.col("g"), "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated")
    kind = F.when(F.col("initial").isin("s", "u", "a"), F.instr(F.lit(SOUND), F.col("initial"))).otherwise(4)
    slim = slim.withColumn("fault", fault).withColumn("kind", kind)
    pick = lambda letters: F.substring(F.lit(letters), F.col("kind"), F.lit(1))
    symbol = F.when(F.col("fault") == "truncated", pick(CUT)).when(F.col("fault").isNotNull(), pick(GONE)).otherwise(pick(SOUND))
    slim = scratch(slim.select("key", "turn", "g", (F.col("before") + F.col("k") - 1).alias("pos"), "count", "fault", symbol.alias("symbol")), "repair-slim")
    return placed.select("conv_id", "key", "g", "role", "text"), slim


# --- the dynamic program over a block: a string of symbols

def _closed(v: list[int]) -> list[int]:
    """Costs to go with inserted rows allowed first."""
    u, a = min(v[2], INSERT + v[3]), min(v[3], INSERT + v[2])
    return [min(v[0], INSERT + u), min(v[1], INSERT + u), u, a]


END = tuple(_closed([0, INF, INF, 0]))


def _moves(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) of a row in a state, in ASCII order of the edits."""
    out = [("D", DELETE, state)]
    if symbol in GONE:
        return out
    extra = TRUNCATED if symbol in CUT else 0
    initial = symbol.lower()
    if state in AFTER.get(initial, {}):
        out.append(("K", extra, AFTER[initial][state]))
    for role in "ua":
        if state in AFTER[role]:
            out.append(("R", REROLE + extra, AFTER[role][state]))
    return out


_MOVES = {(c, q): _moves(c, q) for c in SOUND + CUT + GONE for q in range(4)}


def backward(symbols: str, end: tuple[int, ...]) -> list[tuple[int, ...]]:
    """The vectors of costs to go before every row of a block and after its last."""
    out = [tuple(end)]
    for c in reversed(symbols):
        after = out[-1]
        out.append(tuple(_closed([min(cost + after[nxt] for _, cost, nxt in _MOVES[c, q]) for q in range(4)])))
    return out[::-1]


@lru_cache(maxsize=100_000)
def block_matrix(symbols: str) -> tuple[int, ...]:
    """16 costs: from every state before a block to every state after it."""
    columns = [backward(symbols, tuple(0 if q == j else INF for q in range(4)))[0] for j in range(4)]
    return tuple(min(columns[j][q], INF) for q in range(4) for j in range(4))


@lru_cache(maxsize=100_000)
def walk(symbols: str, end: tuple[int, ...], state: int, last: bool) -> tuple[int, str, tuple[str, ...]]:
    """(state after the block, edits, tokens): the ASCII-least tight edits from ``state``, and per row the initials inserted before it with
    ``k`` (kept), ``d`` (deleted) or the new role's initial in capitals; then a token for what is inserted after the last block."""
    ahead, edits, tokens = backward(symbols, end), [], []
    for t, c in enumerate(symbols):
        token = ""
        while True:
            go, options = ahead[t][state], []
            for edit, cost, nxt in _MOVES[c, state]:
                if cost + ahead[t + 1][nxt] == go:
                    options.append((edit, nxt))
            options += [("I", nxt) for role in "ua" for at, nxt in AFTER[role].items() if at == state and INSERT + ahead[t][nxt] == go]
            edit, nxt = min(options)
            edits.append(edit)
            if edit != "I":
                break
            token, state = token + "sua"[nxt - 1], nxt
        token += {"D": "d", "K": "k"}.get(edit) or "SUA"[nxt - 1]
        tokens.append(token)
        state = nxt
    token = ""
    while last and ahead[-1][state]:
        state = next(nxt for role in "ua" for at, nxt in AFTER[role].items() if at == state and INSERT + ahead[-1][nxt] == ahead[-1][state])
        token += "sua"[state - 1]
        edits.append("I")
    tokens.append(token)
    return state, "".join(edits), tuple(tokens)


def _rows(df: DataFrame, work: Callable[[dict], Iterator[dict]], schema: str) -> DataFrame:
    """``work`` applied to every row (a dict) inside the tasks."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([x for row in batch.to_pylist() for x in work(row)], schema=out)

    return df.mapInArrow(run, schema)


def _matrices(row: dict) -> Iterator[dict]:
    plain = row["symbols"].translate(str.maketrans(CUT + GONE, SOUND + SOUND))
    illegal = sum(plain[i:i + 2] not in ("su", "ua", "au") for i in range(len(plain) - 1))
    yield {"key": row["key"], "block": row["block"], "matrix": list(block_matrix(row["symbols"])), "illegal": illegal, "ends": plain[0] + plain[-1]}


def _checkpoints(row: dict) -> Iterator[dict]:
    """From a conversation's matrices in order: the vector at every block's end, and on the last block the cost and the illegal pairs."""
    blocks, vector = row["blocks"], END
    illegal = sum(b["illegal"] for b in blocks) + sum(a["ends"][1] + b["ends"][0] not in ("su", "ua", "au") for a, b in zip(blocks, blocks[1:], strict=False))
    for i in range(len(blocks) - 1, -1, -1):
        m, after = blocks[i]["matrix"], vector
        vector = tuple(min(m[4 * q + j] + after[j] for j in range(4)) for q in range(4))
        yield {"key": row["key"], "block": blocks[i]["block"], "vector": list(after), "last": i == len(blocks) - 1,
               "cost": vector[0] if i == 0 else None, "illegal": illegal if i == 0 else None}


def _exits(row: dict) -> Iterator[dict]:
    vector = tuple(row["vector"])
    ahead = backward(row["symbols"], vector)[0]
    yield {"key": row["key"], "block": row["block"], "exits": [walk(row["symbols"], vector, q, row["last"])[0] if ahead[q] < INF else 0 for q in range(4)]}


def _entries(row: dict) -> Iterator[dict]:
    state = 0
    for b in row["blocks"]:
        yield {"key": row["key"], "block": b["block"], "state": state}
        state = b["exits"][state]


def _emit(row: dict) -> Iterator[dict]:
    _, edits, tokens = walk(row["symbols"], tuple(row["vector"]), row["state"], row["last"])
    yield {"key": row["key"], "block": row["block"], "start": row["start"], "edits": edits, "tokens": list(tokens)}


def _gathered(df: DataFrame, *columns: str) -> DataFrame:
    """(key, blocks): a conversation's records in order, as many as the square root of its rows."""
    return df.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("block", *columns))).alias("blocks"))


def block_edits(slim: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((key, block, start, edits, tokens), (key, cost, illegal)) for ``slim`` of ``ordered_rows``; ``start`` is the first row's g."""
    length = F.greatest(F.lit(LEAST_BLOCK), F.ceil(F.sqrt("count"))).cast("long")
    cut = slim.select("key", "g", "symbol", F.floor(F.col("pos") / length).cast("long").alias("block"))
    blocks = cut.groupBy("key", "block").agg(F.min("g").alias("start"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("g", "symbol"))), lambda x: x["symbol"]), "").alias("symbols"))
    blocks = scratch(blocks, "repair-blocks")
    matrices = _rows(blocks.select("key", "block", "symbols"), _matrices, "key string, block long, matrix array<long>, illegal long, ends string")
    points = scratch(_rows(_gathered(matrices, "matrix", "illegal", "ends"), _checkpoints, "key string, block long, vector array<long>, last boolean, cost long, illegal long"), "repair-checkpoints")
    known = scratch(blocks.join(points.drop("cost", "illegal"), ["key", "block"]), "repair-known")
    exits = _rows(known.select("key", "block", "symbols", "vector", "last"), _exits, "key string, block long, exits array<int>")
    entries = _rows(_gathered(exits, "exits"), _entries, "key string, block long, state int")
    out = _rows(known.join(entries, ["key", "block"]), _emit, "key string, block long, start long, edits string, tokens array<string>")
    return scratch(out, "repair-edits"), points.where("cost is not null").select("key", "cost", "illegal")


def repaired_lines(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(key, g, kind, tokens, role, text) sorted by key, g and kind within partitions by key: a block's tokens (kind 0) come before its rows."""
    tokens = edits.select("key", F.col("start").alias("g"), F.lit(0).alias("kind"), "tokens", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    lines = rows.select("key", "g", F.lit(1).alias("kind"), F.lit(None).cast("array<string>").alias("tokens"), "role", "text")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tokens.unionByName(lines).repartition(parts, "key").sortWithinPartitions("key", "g", "kind")


def _repairs(role: str | None, text: str | None, token: str) -> list[str]:
    """The lines that a row's token gives: inserted ones, then the row unless it is deleted."""
    out = [f"{NAMES[c]}:" for c in token if c in "ua"]
    how = token[-1:] if role is not None else ""
    if how == "k":
        out.append(f"{role}:{text}")
    elif how in ("U", "A"):
        out.append(f"{NAMES[how.lower()]}:{text}")
    return out


def repaired_digests(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(key, repaired_sha256): the hash runs over a conversation's lines as they stream by, whatever its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest, some, tokens, row = None, hashlib.sha256(), False, [], 0

        def add(lines: list[str]) -> None:
            nonlocal some
            for line in lines:
                digest.update((("\n" if some else "") + line).encode("utf-8", "surrogatepass"))
                some = True

        done: list[tuple[str, str]] = []

        def close() -> None:
            if at is not None:
                done.append((at, digest.hexdigest()))

        for batch in batches:
            for key, kind, given, role, text in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if key != at:
                    close()
                    at, digest, some = key, hashlib.sha256(), False
                if kind == 0:
                    tokens, row = given, 0
                    continue
                add(_repairs(role, text, tokens[row]))
                row += 1
                if row == len(tokens) - 1:  # a block's last row: what is inserted behind it
                    add(_repairs(None, None, tokens[-1]))
            if done:
                yield frame(done)
                done.clear()
        close()
        if done:
            yield frame(done)

    def frame(done: list[tuple[str, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in range(2)], names=["key", "repaired_sha256"])

    return repaired_lines(rows, edits).select("key", "kind", "tokens", "role", "text").mapInArrow(run, "key string, repaired_sha256 string")


def repaired_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, k, role, text): the rows of every conversation of ``turns`` (conv_id, turn, role, text) after its repair, in order.

    Nothing is damaged here first; nulls in role and text are one space."""
    rows, slim = ordered_rows(turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                                           F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text")))
    edits, _ = block_edits(slim)
    first = slim.select("key", F.col("g").alias("start"), F.col("pos").alias("first"))
    tokens = edits.join(first, ["key", "start"]).select("key", "first", F.posexplode("tokens").alias("i", "token"))
    per_row = tokens.select("key", (F.col("first") + F.col("i")).alias("pos"), "token")
    found = rows.join(slim.select("g", "pos"), "g").select("key", "pos", "role", "text").join(per_row, ["key", "pos"], "right")
    found = found.join(rows.groupBy("key").agg(F.max("conv_id").alias("conv_id")), "key")
    inserted = F.filter(F.split("token", ""), lambda c: c.isin("u", "a"))
    name = lambda c: F.when(c == "u", "user").otherwise("assistant")
    made = F.transform(inserted, lambda c, i: F.struct(i.alias("i"), name(c).alias("role"), F.lit("").alias("text")))
    how = F.when(F.col("role").isNotNull(), F.substring("token", -1, 1)).otherwise("")
    role = F.when(how == "k", F.col("role")).when(how == "U", "user").when(how == "A", "assistant")
    own = F.when(role.isNotNull(), F.array(F.struct(F.lit(1 << 20).alias("i"), role.alias("role"), F.col("text"))))
    lines = found.select("conv_id", "pos", F.explode(F.concat(made, F.coalesce(own, F.expr("cast(array() as array<struct<i:int,role:string,text:string>>)")))).alias("x"))
    return lines.select("conv_id", F.struct("pos", "x.i").alias("k"), "x.role", "x.text")


def repair_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation of ``turns``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, after damage.

    Null roles and texts, and null ids in the damage's checksum, are one space; the rows of a null conversation are one
    conversation; a null turn comes first and is in no gap; rows of one turn are taken by role and text.  A repeated row is a row (and a duplicate).  A
    conversation without rows after the damage has zeros, an empty audit and the hash of an empty text.  An empty table gives no rows.
    Other columns are not read.
    """
    ids = turns.select(col(conv).alias("conv_id")).distinct()
    damaged = damage(small_batches(turns), conv, turn, role, text)
    rows, slim = ordered_rows(damaged)
    edits, costs = block_edits(slim)
    named = slim.groupBy("key").agg(*[F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")])
    by_turn = slim.groupBy("key", "turn").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    audit = edits.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "edits"))), lambda x: x["edits"]), "").alias("audit"))
    told = named.join(by_turn, "key").join(costs, "key").join(audit, "key").join(repaired_digests(rows, edits), "key")
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    out = ids.withColumn("key", key).join(told, "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                      F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
