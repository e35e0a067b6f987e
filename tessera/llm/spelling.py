"""Spelling variants: one-edit neighbours found on a relational trie, level by level.

The frequent words are kept in two tries, one over the words and one over the words read backwards.  A trie is a table: one row per
node with its outgoing edges.  Only nodes where words part or end are kept, so an edge carries one character or more.  A state is
(word, rest of it, node, edits).  Two words one edit apart part at a node of both their paths; in one of the two tries that node
lies in the second half of the longer word.  So states with an edit start at the nodes of a word's second half, where the
next character is replaced or deleted, and each level joins all states with the node table: a state whose rest is used up at
a word's node is a pair of neighbours, any other follows the edge that its rest begins with.  An insertion is the
other word's deletion.

Nodes and edge labels are compared by 64-bit hashes, which can only add states; every pair is confirmed on the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, col, discard, join_groups, scratch, table
from tessera.llm.minhash import mix64

#: Fixed values of the task: letters of a word, its least length and count, the share of runs that lose a character, and
#: how many times more frequent a form is than its variants.
LETTERS, MIN_CHARS, MIN_COUNT, DROP_EVERY, FORM_RATIO = r"A-Za-zÀ-ÿ", 6, 5, 199, 5
_K = np.uint64(0xD1342543DE82EF95)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT,
                drop_every: int = DROP_EVERY) -> DataFrame:
    """(word, n): runs of letters in lower case (A-Z only), one character dropped where drop_every divides the run's hash, that are
    long and frequent enough.  A null text has no runs, a null id counts as an empty text."""
    runs = docs.select(F.coalesce(col(id_col).cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(ascii_lower(col(text_col)), F.lit(f"[{LETTERS}]{{{min_chars},}}"), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    runs = runs.select("run", h.alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % drop_every == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    counts = runs.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where((F.col("n") >= min_count) & (F.length("word") >= min_chars))


def _hashed_prefixes(words: list[str], start: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(index of the word, position, hash of its first ``position`` characters), from position ``start`` on, a position at a time."""
    size = np.array([len(w) for w in words])
    order = np.argsort(-size, kind="stable")
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    first = np.cumsum(size) - size
    h = np.full(len(words), np.uint64(seed))
    ends = np.sort(-size)
    for at in range(int(size.max(initial=0)) + 1):
        live = order[:np.searchsorted(ends, -at, side="right")]  # words of at least ``at`` characters
        if at:
            h[live] = mix64(h[live] * _K + flat[first[live] + at - 1])
        if at >= start:
            yield live, np.full(len(live), at), h[live]


def trie_paths(words: DataFrame, start: int) -> DataFrame:
    """(back, word, n, pos, node): the nodes on every word's path in both tries, from position ``start`` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                piece = batch.slice(at, 2000)
                texts = piece.column(0).to_pylist()
                for back in (False, True):
                    held, n = [], 0
                    for part in _hashed_prefixes([w[::-1] for w in texts] if back else texts, start, 1 + back):
                        held.append(part)
                        n += len(part[0])
                        if n >= 100_000:
                            yield frame(piece, held, back)
                            held, n = [], 0
                    if n:
                        yield frame(piece, held, back)

    def frame(piece: pa.RecordBatch, held: list, back: bool) -> pa.RecordBatch:
        index, pos, node = (np.concatenate([p[i] for p in held]) for i in range(3))
        took = piece.take(pa.array(index))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(index), back)), took.column(0), took.column(1), pa.array(pos, pa.int32()), pa.array(node.view(np.int64))],
                                          names=["back", "word", "n", "pos", "node"])

    return words.select("word", "n").mapInArrow(run, "back boolean, word string, n long, pos int, node long")


def _oriented() -> Column:
    return F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word"))


def kept_paths(words: DataFrame, start: int) -> DataFrame:
    """(back, word, n, path array<struct<pos, node>>): of every word's path the nodes where words part or end, in order."""
    paths = scratch(trie_paths(words, start), "trie-paths")
    step = F.substring(_oriented(), F.col("pos") + 1, F.lit(1))
    nodes = paths.withColumn("next", step).groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("next").alias("a"), F.max("next").alias("b"))
    # the empty string marks an end and is the smallest: where a word ends, or words part, there are two values or the empty one
    nodes = nodes.where("a <> b or a = ''").select("node", "size")
    kept = join_groups(paths, nodes, ["node"], "size", paths.count())
    out = kept.groupBy("back", "word").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "node"))).alias("path"))
    out = scratch(out, "trie-kept")
    discard(paths)
    return out


def node_table(paths: DataFrame) -> DataFrame:
    """(node, word, n, edges array<struct<c, len, tail, child>>): word and n where one ends, and the edges to the next kept nodes: first
    character, number of characters, hash of the further ones, child.  A node has no more edges than there are letters."""
    hops = paths.select("back", "word", F.explode(F.transform(F.slice("path", F.lit(1), F.size("path") - 1), lambda x, i: F.struct(
        x["node"].alias("node"), x["pos"].alias("pos"), (F.get("path", i + 1)["pos"] - x["pos"]).alias("len"), F.get("path", i + 1)["node"].alias("child")))).alias("e"))
    text = _oriented()
    edges = hops.select(F.col("e.node").alias("node"), F.substring(text, F.col("e.pos") + 1, F.lit(1)).alias("c"), F.col("e.len").alias("len"),
                        F.xxhash64(F.substring(text, F.col("e.pos") + 2, F.col("e.len") - 1)).alias("tail"), F.col("e.child").alias("child")).distinct()
    ends = paths.select(F.element_at("path", -1)["node"].alias("node"), F.struct("word", "n").alias("end"))
    none = "cast(null as struct<c:string,len:int,tail:bigint,child:bigint>)"
    rows = edges.select("node", F.struct("c", "len", "tail", "child").alias("edge"), F.expr("cast(null as struct<word:string,n:bigint>)").alias("end"))
    rows = rows.unionByName(ends.select("node", F.expr(none).alias("edge"), "end"))
    grouped = rows.groupBy("node").agg(F.collect_list("end").alias("ends"), F.collect_list("edge").alias("edges"))
    return scratch(grouped, "trie-nodes")


def _met(states: DataFrame, nodes: DataFrame) -> tuple[DataFrame, int]:
    """Every state with its node's row, and the number of states.  Hot nodes are found by counting the states."""
    states = scratch(states, "trie-states")
    total = states.count()
    sizes = states.groupBy("node").agg(F.count(F.lit(1)).alias("size"))
    return join_groups(states, nodes.join(sizes, "node"), ["node"], "size", total), total


def _tail_is(rest: Column, edge: Column) -> Column:
    return (edge["len"] <= F.length(rest) + 1) & (edge["tail"] == F.xxhash64(F.substring(rest, F.lit(1), edge["len"] - 1)))


def near_words(words: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(word, n, near, near_n): both directions of every pair of ``words`` (word, n; each word once) that one inserted, deleted or replaced
    character tells apart.  ``min_chars`` is the least length of a word."""
    paths = kept_paths(words, min_chars // 2)
    nodes = node_table(paths)
    own = paths.select("word", "n", _oriented().alias("text"), F.explode(F.filter("path", lambda x: (x["pos"] >= F.floor(F.length("word") / 2)) & (x["pos"] < F.length("word")))).alias("at"))
    own = own.select("word", "n", F.substring("text", F.col("at.pos") + 1, F.length("text")).alias("rest"), F.col("at.node").alias("node"))
    met, _ = _met(own, nodes)
    here, rest = F.substring("rest", F.lit(1), F.lit(1)), F.substring("rest", F.lit(2), F.length("rest"))
    after = F.substring("rest", F.lit(2), F.lit(1))
    met = met.select("word", "n", "node", "ends", rest.alias("rest"), here.alias("here"), after.alias("after"), "edges")
    # replaced: a later character than the own one (the other word replaces the other way round); deleted: the edge of the character after it
    met = met.withColumn("to", F.filter("edges", lambda e: ((e["c"] > F.col("here")) & _tail_is(F.col("rest"), e)) | (
        (e["c"] == F.col("after")) & (e["c"] != F.col("here")) & _tail_is(F.substring("rest", F.lit(2), F.length("rest")), e))))
    met = scratch(met.where((F.size("to") > 0) | (F.col("rest") == "")).drop("edges"), "trie-edits")
    pair = F.explode("ends").alias("end")
    pairs = [met.where("rest = ''").select("word", "n", pair)]
    moves = met.select("word", "n", "here", "after", "rest", F.explode("to").alias("e"))
    replaced = moves.where(F.col("e.c") > F.col("here")).where(_tail_is(F.col("rest"), F.col("e"))).select("word", "n", F.substring("rest", F.col("e.len"), F.length("rest")).alias("rest"), F.col("e.child").alias("node"))
    deleted = moves.where((F.col("e.c") == F.col("after")) & (F.col("e.c") != F.col("here")))
    deleted = deleted.where(_tail_is(F.substring("rest", F.lit(2), F.length("rest")), F.col("e"))).select("word", "n", F.substring("rest", F.col("e.len") + 1, F.length("rest")).alias("rest"), F.col("e.child").alias("node"))
    states = replaced.unionByName(deleted)
    while True:
        met, total = _met(states, nodes)
        if not total:
            break
        pairs.append(scratch(met.where("rest = ''").select("word", "n", pair), "trie-pairs"))
        follow = F.filter("edges", lambda e: (e["c"] == F.substring("rest", F.lit(1), F.lit(1))) & _tail_is(F.substring("rest", F.lit(2), F.length("rest")), e))
        on = met.where("rest <> ''").select("word", "n", "rest", F.explode(follow).alias("e"))
        states = on.select("word", "n", F.substring("rest", F.col("e.len") + 1, F.length("rest")).alias("rest"), F.col("e.child").alias("node"))
    found = pairs[0]
    for p in pairs[1:]:
        found = found.unionByName(p)
    found = found.select("word", "n", F.col("end.word").alias("near"), F.col("end.n").alias("near_n")).where(F.levenshtein("word", "near", 1) == 1)
    both = found.unionByName(found.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return scratch(both.distinct(), "trie-near")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms`` (word, form): where following forms ends.  Every round doubles the steps taken; a form is several times
    as frequent as its word, so chains are short."""
    now = scratch(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = scratch(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        if not new.where("moved").limit(1).count():
            return new.select("word", "root")
        now = new.drop("moved")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT,
                      drop_every: int = DROP_EVERY, ratio: int = FORM_RATIO) -> DataFrame:
    """One row per frequent word: word, form, root, n, n_near, form_n.

    ``n_near`` counts the words one edit away; ``form`` is the most frequent of them (of equal ones the smallest) if it is at least
    ``ratio`` times as frequent, ``root`` the end of the chain of forms, the word itself without one.  Null, empty and wordless texts add nothing; a
    repeated row counts each time; a null id is hashed as an empty one.  An empty table gives no rows.  Other columns are not read.
    """
    words = scratch(word_counts(docs, id_col, text_col, min_chars, min_count, drop_every), "spelling-words")
    near = near_words(words, min_chars)
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("b"))
    told = words.join(best, "word", "left").withColumn("form_n", -F.col("b.less"))
    told = told.withColumn("form_n", F.when(F.col("form_n") >= ratio * F.col("n"), F.col("form_n")))
    told = scratch(told.select("word", F.when(F.col("form_n").isNotNull(), F.col("b.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n"), "spelling-forms")
    ends = roots(told.where("form is not null").select("word", "form"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))
