"""Packing token sequences: concatenate all documents and cut the stream into fixed windows.

Two passes.  The first tokenizes each document once and notes its offset within its partition; the partitions'
token totals, added up in order, give every document its offset in the whole stream.  The second cuts the stream at the
multiples of the window length: windows that lie inside a task are finished there, and the cut ones at its ends are
boundary records, joined by their window number.  Only the last window of all is padded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.llm.common import col, discard, scratch, small_batches, table

WINDOW, END_ID, PAD_ID = 1024, 0, 0
VOCABULARY = "byte_bpe_50k"


@lru_cache(maxsize=4)
def encoder(vocabulary: str):
    """text -> ids of the public tokenizer file ``<vocabulary>.json`` without added special tokens; a special string that a text
    holds is one id, as the file has it.

    A text that holds none of the file's special strings and only Latin characters is encoded from the same vocabulary's rank
    file, which gives the same ids several times faster; all others by the tokenizer file itself."""
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
    added = [re.escape(t.content) for t in whole.get_added_tokens_decoder().values()]
    # beyond these characters, two libraries' Unicode tables might class a character differently
    beyond = re.compile("|".join(["[^\x00-\u024f]", *added]))
    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    quick = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if beyond.search(text):
            return whole.encode(text, add_special_tokens=False).ids
        return quick.encode_ordinary(text)

    return encode


def token_stream(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(part, local, doc_id, doc_tokens, ids): each document's ids with END_ID, as little-endian 32-bit
    numbers, and the tokens before it in its partition."""
    kind = docs.select(col(id_col)).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, local = encoder(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            step = 256
            for at in range(0, batch.num_rows, step):
                piece = batch.slice(at, step)
                ids = [np.array([*encode(t or ""), END_ID], dtype="<u4") for t in piece.column(1).to_pylist()]
                n = np.array([len(x) for x in ids], dtype=np.int64)
                starts = local + np.cumsum(n) - n
                local += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part)), pa.array(starts), piece.column(0), pa.array(n), pa.array([x.tobytes() for x in ids], pa.binary())],
                    names=["part", "local", "doc_id", "doc_tokens", "ids"])

    schema = f"part long, local long, doc_id {kind}, doc_tokens long, ids binary"
    return docs.select(col(id_col), col(text_col).cast("string")).mapInArrow(run, schema)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
         vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per sequence: sequence_id, n_tokens, ids (binary, ``window`` little-endian 32-bit ids, padded with
    PAD_ID), pieces array<struct<offset, doc_id, start, length, doc_tokens>> in order.

    A null or empty text is one END_ID.  A document longer than a window goes on in the next ones.  Documents follow each
    other in the order of the input's partitions; repeated rows are packed as often as they come, and null ids too.
    An empty table gives no sequences.  Other columns are not read.
    """
    kind = docs.select(col(id_col)).schema[0].dataType.simpleString()
    stream = scratch(token_stream(small_batches(docs), id_col, text_col, vocabulary), "pack-stream")
    totals = stream.groupBy("part").agg(F.sum("doc_tokens").alias("n"))  # one row per partition of the input
    bases = totals.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base"))
    placed = stream.join(F.broadcast(bases), "part").select("doc_id", "doc_tokens", (F.col("base") + F.col("local")).alias("at"), "ids")
    piece = f"array<struct<offset:long,doc_id:{kind},start:long,length:long,doc_tokens:long>>"

    spec = f"sequence_id long, first long, n long, ids binary, pieces {piece}"
    out = to_arrow_schema(StructType.fromDDL(spec))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[dict] = []
        parts: list[bytes] = []
        pieces: list[dict] = []
        first = end = -1

        def close() -> None:
            if pieces:
                done.append({"sequence_id": first // window, "first": first % window, "n": end - first, "ids": b"".join(parts), "pieces": list(pieces)})
                parts.clear()
                pieces.clear()

        for batch in batches:
            ids_of = batch.column(3)
            for k, (doc, total, at) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)):
                if at != end:
                    close()
                    first = end = at
                raw, start = ids_of[k].as_py(), 0
                while start < total:
                    length = min(total - start, window - end % window)
                    pieces.append({"offset": end % window, "doc_id": doc, "start": start, "length": length, "doc_tokens": total})
                    parts.append(raw[4 * start:4 * (start + length)])
                    start, end = start + length, end + length
                    if end % window == 0:
                        close()
                        first = end
                    if len(done) >= 500:
                        yield pa.RecordBatch.from_pylist(done, schema=out)
                        done = []
        close()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=out)

    runs = scratch(placed.mapInArrow(cut, spec), "pack-runs")
    discard(stream)
    whole = runs.where(F.col("n") == window).select("sequence_id", F.col("n").alias("n_tokens"), "ids", "pieces")
    edges = runs.where(F.col("n") < window).groupBy("sequence_id").agg(
        F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("first", "ids", "pieces"))).alias("r"))  # at most ``window`` records
    joined = F.aggregate("r", F.lit(b""), lambda s, x: F.concat(s, x["ids"]))
    pad = F.lit(int(PAD_ID).to_bytes(4, "little") * window)
    edges = edges.select("sequence_id", "n_tokens", F.concat(joined, F.substring(pad, F.lit(1), ((F.lit(window) - F.col("n_tokens")) * 4).cast("int"))).alias("ids"),
                         F.flatten(F.transform("r", lambda x: x["pieces"])).alias("pieces"))
    return whole.unionByName(edges)


def piece_rows(sequences: DataFrame) -> DataFrame:
    """One row per piece of a document, with the CRC-32 of its ids, read from the packed sequences."""
    p = sequences.select("sequence_id", "ids", F.explode("pieces").alias("p"))
    part = F.substring("ids", (F.col("p.offset") * 4 + 1).cast("int"), (F.col("p.length") * 4).cast("int"))
    return p.select(F.col("p.doc_id").alias("doc_id"), F.col("p.start").alias("start"), F.col("p.length").alias("length"),
                    F.crc32(part).alias("ids_crc32"), F.col("p.doc_tokens").alias("doc_tokens"), "sequence_id", F.col("p.offset").alias("offset"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_rows(pack(table(spark, sf_dir, "documents").select("doc_id", "text")))
