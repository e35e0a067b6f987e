"""Mixing by iterative proportional fitting: token weights raked to source, language and topic marginals.

Tokens are added up per (source, language, topic) cell.  The targets are first fitted to the tokens at hand: no level may be asked for more
than all its tokens, what it cannot take is shared out to the other levels.  Then each sweep scales the cell weights to the
target of every source, of every language and of every topic, until all three marginals hold; a cell gives no more than its tokens.  A
document is sampled with its cell's probability, by a hash of its id.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.common import SPACE_CLASS, SPACES, col, join_groups, keep_ids, scratch, table

ATTRS = ("source", "lang", "topic")
#: Default targets: a level's share of all tokens, raised to ALPHA and normalised.  Share of all tokens that a sample has: KEEP.
ALPHA, KEEP, TOLERANCE, SEED = 0.8, 0.5, 1e-4, 17
#: A target is at most this share of what its level could give.  Sweeps are run so many at a time, and so often at most; they end
#: earlier when so many sweeps have not brought the largest gap below STALLED of what it was.
ROOM, SWEEPS, RUNS, STALLED = 0.98, 5, 12, 0.7
#: Default targets that contradict each other are drawn towards the tokens' own shares, which always agree, by half each time.
DRAWS = 4
#: Up to so many cells are swept as arrays in one task, which spares all shuffles; more are spread over the tasks.
FEW_CELLS = 100_000


def text_form(text: Column, n_words: Column, chars: Column) -> Column:
    """The default topic of a text, from its form: empty, table, symbols, shout, short, long or prose.  ``chars``: its characters
    in words, one at least."""
    share = lambda drop: (F.length(text) - F.length(F.translate(text, drop, ""))) / chars
    return (F.when(n_words == 0, "empty").when(share("|") > 0.05, "table").when(share("#*$%&<>") > 0.05, "symbols")
            .when(share("ABCDEFGHIJKLMNOPQRSTUVWXYZ") > 0.5, "shout")
            .when(n_words < 100, "short").when(n_words > 2000, "long").otherwise("prose"))


def mixing_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                lang_col: str = "lang", topic_col: str | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, tokens): what mixing looks at.  Tokens are words; null levels become ''."""
    df = docs.select(col(id_col).alias("doc_id"), F.coalesce(col(source_col).cast("string"), F.lit("")).alias("source"),
                     F.coalesce(col(lang_col).cast("string"), F.lit("")).alias("lang"),
                     F.coalesce(col(text_col), F.lit("")).alias("__text"),
                     *([F.coalesce(col(topic_col).cast("string"), F.lit("")).alias("topic")] if topic_col else []))
    bare = F.btrim("__text", F.lit(SPACES))
    df = df.withColumn("tokens", F.when(bare == "", 0).otherwise(F.size(F.split(bare, SPACE_CLASS + "+"))).cast("long"))
    if not topic_col:
        df = df.withColumn("__chars", F.greatest(F.length(F.translate("__text", SPACES, "")), F.lit(1)))
        df = df.withColumn("topic", text_form(F.col("__text"), F.col("tokens"), F.col("__chars")))
    return df.select("doc_id", *ATTRS, "tokens")


def level_targets(cells: DataFrame, wanted: dict[str, dict[str, float] | None], keep: float, alpha: float = ALPHA) -> tuple[DataFrame, float]:
    """((attr, level, own, asked, target), share of tokens kept): shares of every level that has tokens.

    ``own`` is the level's share of all tokens, ``asked`` what is wanted: levels that ``wanted[attr]`` doesn't name share what it leaves over
    (nothing if it sums to 1), by their tokens; without ``wanted[attr]`` shares are tempered by ``alpha``.  ``target`` is ``asked``
    bounded by ROOM of what the level can give to a sample of ``keep`` (its own share if that is more), the rest shared out in proportion to ``asked`` until
    nothing is over.  Where all levels asked for together cannot fill the sample, it is that much smaller."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 1)
    level = F.explode(F.array(*[F.struct(F.lit(a).alias("attr"), F.col(a).alias("level")) for a in ATTRS])).alias("x")
    sums = cells.where("tokens > 0").select(level, "tokens").groupBy("x.attr", "x.level").agg((F.sum("tokens") / total).alias("own"))
    raw = F.pow("own", alpha)
    for attr in ATTRS:
        if wanted.get(attr) is not None:
            named = F.lit(None).cast("double")
            for name, share in wanted[attr].items():
                named = F.when(F.col("level") == name, F.lit(float(share))).otherwise(named)
            spare = F.lit(max(0.0, 1.0 - sum(wanted[attr].values())))
            free = F.sum(F.when(named.isNull(), F.col("own"))).over(W.partitionBy("attr"))
            raw = F.when(F.col("attr") == attr, F.coalesce(named, spare * F.col("own") / free)).otherwise(raw)
    levels = sums.withColumn("raw", raw)
    levels = scratch(levels.withColumn("asked", F.col("raw") / F.sum("raw").over(W.partitionBy("attr"))).drop("raw"), "mix-levels")
    most = {r.attr: r.m for r in levels.where("asked > 0").groupBy("attr").agg(F.sum("own").alias("m")).collect()}
    keep = min([keep, *(ROOM * m for m in most.values())])
    cap = F.least(F.lit(1.0), F.greatest(F.col("own"), F.lit(ROOM / keep) * F.col("own")))
    scale = dict.fromkeys(ATTRS, 1.0)

    def factor() -> Column:
        out = F.lit(1.0)
        for attr in ATTRS:
            out = F.when(F.col("attr") == attr, F.lit(scale[attr])).otherwise(out)
        return out

    while True:  # the scale of an attribute only grows, and with it the levels at their bound
        full = factor() * F.col("asked") >= cap
        got = levels.where("asked > 0").groupBy("attr").agg(F.sum(F.when(full, cap).otherwise(0.0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("asked"))).alias("free")).collect()
        new = {r.attr: (1 - r.full) / r.free if r.free > 1e-12 else scale[r.attr] for r in got}
        if all(v <= scale[a] * (1 + 1e-9) for a, v in new.items()):
            break
        scale = {a: max(scale[a], new.get(a, 1.0)) for a in ATTRS}
    return scratch(levels.withColumn("target", F.least(cap, factor() * F.col("asked"))), "mix-targets"), keep


def rake_within(cells: DataFrame, wanted: dict[str, dict[str, float] | None], keep: float = KEEP, alpha: float = ALPHA,
                tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame, float]:
    """(``cells`` that have tokens with ``probability``, a report, share of all tokens kept).

    Raking under the bound probability <= 1: a cell's weight grows on behind the bound, but counts with no more than its tokens, so
    what a cell kept whole lacks is made up for by the free cells of the same level.  The targets are those of ``level_targets``; if the
    attributes contradict each other, those without wishes are drawn towards the tokens' own shares.  If wishes still contradict, the
    last weights are scaled to the share, and a warning tells.  The report has a row per level: attr, level, own, asked, target, share (in the sample), gap
    (relative to target)."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 1)
    levels, keep = level_targets(cells, wanted, keep, alpha)
    free = [a for a in ATTRS if wanted.get(a) is None]
    start, now, worst = cells.where("tokens > 0").withColumn("cap", F.col("tokens") / F.lit(total)), None, 0.0
    for draw in range(DRAWS):
        if draw:  # the last time to the own shares themselves
            part = F.lit(1.0 if draw == DRAWS - 1 else 0.5)
            drawn = F.col("target") + part * (F.col("own") - F.col("target"))
            levels = scratch(levels.withColumn("target", F.when(F.col("attr").isin(*free), drawn).otherwise(F.col("target"))), "mix-targets")
        put = start
        for a in ATTRS:
            put = put.join(levels.where(F.col("attr") == a).select(F.col("level").alias(a), (F.col("target") * keep).alias(f"want_{a}")), a)
        now, worst = _raked(put.withColumn("weight", F.col("cap") * keep), tolerance)
        if worst <= tolerance or not free:
            break
    if worst > tolerance:
        now = _scaled(now, keep)
    mass = F.least("weight", "cap")
    held = now.agg(F.sum(mass)).first()[0] or 1.0
    level = F.explode(F.array(*[F.struct(F.lit(a).alias("attr"), F.col(a).alias("level")) for a in ATTRS])).alias("x")
    shares = now.select(level, mass.alias("m")).groupBy("x.attr", "x.level").agg((F.sum("m") / held).alias("share"))
    report = levels.join(shares, ["attr", "level"], "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
    report = scratch(report.withColumn("gap", F.abs(F.col("share") - F.col("target")) / F.greatest("target", F.lit(1e-12))), "mix-report")
    asked = F.col("attr").isin(*[a for a in ATTRS if a not in free])
    short = report.where((asked & (F.abs(F.col("asked") - F.col("target")) > 0.001)) | (F.col("gap") > 10 * tolerance))
    told = [(r.attr, r.level, round(r.asked, 4), round(r.share, 4)) for r in short.orderBy(F.desc(F.abs(F.col("asked") - F.col("share"))), "attr", "level").limit(10).collect()]
    if told:
        warnings.warn(f"mixing: not all wanted shares can be had in a sample of {held:.3f} of the tokens (attribute, level, asked, got): {told}", stacklevel=2)
    return now.select(*ATTRS, "tokens", "docs", F.least(F.lit(1.0), F.col("weight") / F.col("cap")).alias("probability")), report, held


def _raked(now: DataFrame, tolerance: float) -> tuple[DataFrame, float]:
    """``now`` (ATTRS, cap, want_*, weight) after sweeps, and the largest relative gap of a level; SWEEPS sweeps make one job."""
    if now.count() <= FEW_CELLS:
        now = scratch(_swept_arrays(now, tolerance), "rake")
        return now.drop("off"), now.agg(F.max("off")).first()[0] or 0.0
    before = float("inf")
    for _ in range(RUNS):
        for k in range(SWEEPS):
            now = now.withColumn("off", F.lit(0.0))
            for attr in ATTRS:  # windows over cells, which are few beside documents
                level, want = W.partitionBy(attr), F.col(f"want_{attr}")
                now = now.withColumn("held", F.sum(F.least("weight", "cap")).over(level)).withColumn(
                    "open", F.sum(F.when(F.col("weight") < F.col("cap"), F.col("weight")).otherwise(0.0)).over(level))
                held, open_ = F.col("held"), F.col("open")
                # the sum is concave in the factor: a Newton step from below stays below, one from above may go too far
                factor = (F.when((want <= 0) | (held <= 0), 0.0).when(open_ <= 0, F.least(F.lit(1.0), want / held))
                          .otherwise(F.least(F.lit(1e6), F.greatest(1 + (want - held) / open_, want / held / 2))))
                now = now.withColumn("off", F.greatest("off", F.when(want > 0, F.abs(held / want - 1)).otherwise(0.0))).withColumn("weight", F.col("weight") * factor)
            now = now.drop("held", "open") if k == SWEEPS - 1 else now.drop("held", "open", "off")
        now = scratch(now, "rake")
        worst = now.agg(F.max("off")).first()[0] or 0.0
        now = now.drop("off")
        if worst <= tolerance or worst > STALLED * before:
            break
        before = worst
    return now, worst


def _swept_arrays(now: DataFrame, tolerance: float) -> DataFrame:
    """``now`` with the weights after the same sweeps and ``off``, the largest relative gap: FEW_CELLS rows at most, in one task."""

    def sweep(levels: list[np.ndarray], wants: list[np.ndarray], cap: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
        off = 0.0
        for level, want in zip(levels, wants, strict=True):
            held = np.bincount(level, np.minimum(weight, cap))
            free = np.bincount(level, np.where(weight < cap, weight, 0.0))
            with np.errstate(divide="ignore", invalid="ignore"):
                factor = np.minimum(1e6, np.maximum(1 + (want - held) / free, want / held / 2))
                factor = np.where(free <= 0, np.minimum(1.0, want / held), factor)
                gaps = np.abs(held / want - 1)
            off = max(off, gaps[want > 0].max(initial=0.0))
            weight = weight * np.where((want <= 0) | (held <= 0), 0.0, factor)[level]
        return weight, off

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        held = pa.Table.from_batches(parts)
        cap, weight = held["cap"].to_numpy(), held["weight"].to_numpy()
        levels, wants = [], []
        for attr in ATTRS:
            _, first, index = np.unique(held[attr].to_numpy(zero_copy_only=False), return_index=True, return_inverse=True)
            levels.append(index)
            wants.append(held[f"want_{attr}"].to_numpy()[first])
        before = off = float("inf")
        for k in range(RUNS * SWEEPS):
            weight, off = sweep(levels, wants, cap, weight)
            if off <= tolerance:
                break
            if k % SWEEPS == SWEEPS - 1:
                if off > STALLED * before:
                    break
                before = off
        out = held.set_column(held.column_names.index("weight"), "weight", pa.array(weight)).append_column("off", pa.array(np.full(len(weight), off)))
        yield from out.combine_chunks().to_batches()

    from pyspark.sql.types import DoubleType, StructType
    return now.coalesce(1).mapInArrow(run, StructType(list(now.schema.fields)).add("off", DoubleType()))


def _scaled(now: DataFrame, keep: float) -> DataFrame:
    """The weights times the number for which, bounded by the caps, they add up to ``keep``."""
    c = 0.0
    while True:
        full = F.lit(c) * F.col("weight") >= F.col("cap")
        got = now.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("free")).first()
        new = (keep - got.full) / got.free if got.free else c
        if new <= c * (1 + 1e-9):
            return now.withColumn("weight", F.col("weight") * F.lit(c or 1.0))
        c = new


def mixing_cells(rows: DataFrame) -> DataFrame:
    """(ATTRS, tokens, docs) of ``mixing_rows``."""
    return scratch(rows.groupBy(*ATTRS).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "mix-cells")


def mixing_report(docs: DataFrame, targets: dict[str, dict[str, float] | None] | None = None, alpha: float = ALPHA, keep: float = KEEP, **cols: str) -> DataFrame:
    """(attr, level, own, asked, target, share, gap): what ``mixing_weights`` of the same arguments aims at and expects to get."""
    return rake_within(mixing_cells(mixing_rows(docs, **cols)), targets or {}, keep, alpha)[1]


def mixing_weights(docs: DataFrame, targets: dict[str, dict[str, float] | None] | None = None, alpha: float = ALPHA,
                   keep: float = KEEP, **cols: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, ATTRS, tokens, probability, kept.

    The sample's expected marginals are the targets of ``level_targets``, and it has ``keep`` of all tokens (``rake_within``; wishes that
    cannot be met give a warning, and ``mixing_report`` tells them level by level).  Documents without words have no tokens to weigh; they are in no marginal and are kept.
    Nulls: see ``mixing_rows``; a null id has a hash like any other id and rows of one id share their fate.
    An empty table gives no rows.
    """
    rows = scratch(mixing_rows(docs, **cols), "mix-rows")
    cells = mixing_cells(rows)
    raked, _, _ = rake_within(cells, targets or {}, keep, alpha)
    prob = scratch(raked.select(*ATTRS, "docs", "probability")
                   .unionByName(cells.where("tokens = 0").select(*ATTRS, "docs", F.lit(1.0).alias("probability"))), "mix-probability")
    total = cells.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]
    told = join_groups(rows, prob, list(ATTRS), "docs", total)
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(SEED)), 11) / F.lit(float(1 << 53))
    return told.select("doc_id", *ATTRS, "tokens", "probability", (draw < F.col("probability")).alias("kept"))


def mix(docs: DataFrame, id_col: str = "doc_id", **args) -> DataFrame:
    """The sampled rows of ``docs``, all columns."""
    return keep_ids(docs, id_col, mixing_weights(docs, id_col=id_col, **args).where("kept"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixing_weights(docs, {"lang": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}})
