"""Spelling variants, resharding and conversation repair against brute force and on odd input."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import repair, resharding, spelling
from tests.llm import frames

CLASH = ("word", "n", "node", "size", "at", "part", "shard", "slot", "key", "pos", "block", "fault", "role_", "count")


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASH if c not in df.columns})


# --- spelling

def variants(rows, min_count=5, every=199):
    counts = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = frames.ascii_lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            k = h % len(run)
            counts[run[:k] + run[k + 1:] if h % every == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= min_count}
    masked, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            masked[w[:i], w[i + 1:]].add(w)
            shorter = w[:i] + w[i + 1:]
            if shorter in words:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in masked.values():
        for w in group:
            near[w] |= group - {w}
    best = {w: min(near[w], key=lambda x: (-words[x], x)) for w in words if near[w]}
    form = {w: b for w, b in best.items() if words[b] >= 5 * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items()}


def variants_of(df, **args):
    got = spelling.spelling_variants(df, **args).collect()
    assert len(got) == len({r.word for r in got})
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got}


def test_variants_of_dense_and_long_words(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abÀ") for _ in range(rng.randrange(5, 10))) for _ in range(300)]
    words += ["spelling", "speling", "spellling", "spellin", "pelling", "spelleng", "aaaaaa", "aaaaaaa", "aaaaaaaa", "x" * 900, "x" * 901, "x" * 450 + "y" + "x" * 449]
    rows = [(i, " ".join(f"{w}{rng.choice(['.', ' ', '×', '3'])}" for w in rng.choices(words, weights=[1 / (k % 17 + 1) ** 2 for k in range(len(words))], k=200))) for i in range(120)]
    rows += [(i, "SPELLING " * 60) for i in range(1000, 1004)]
    want = variants(rows)
    assert sum(v[0] is not None for v in want.values()) > 20 and any(v[1] != v[0] for v in want.values() if v[0])
    assert variants_of(clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == want


def test_variants_on_odd_rows(spark):
    assert variants_of(frames.odd_docs(spark, CLASH), min_count=2) == variants(frames.odd_rows(), min_count=2)
    assert spelling.spelling_variants(frames.empty_docs(spark)).count() == 0


def test_variants_of_the_table(spark):
    docs = spark.read.parquet(f"{frames.SF}/documents.parquet").select("doc_id", "text")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.op11_spelling(spark, frames.SF).collect()}
    assert got and got == variants([tuple(r) for r in docs.collect()])


def test_chains_of_forms_end(spark):
    forms = [(f"w{i:02}", f"w{i + 1:02}") for i in range(20)] + [("a", "w03"), ("b", "c")]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(forms, "word string, form string")).collect()}
    assert got == {**{f"w{i:02}": "w20" for i in range(20)}, "a": "w20", "b": "c"}


# --- resharding

def test_flow_is_cheapest():
    rng = random.Random(7)
    for _ in range(40):
        m, n = rng.randrange(1, 6), rng.randrange(1, 6)
        supply = [rng.randrange(0, 12) for _ in range(m)]
        demand = [0] * n
        for _ in range(sum(supply)):
            demand[rng.randrange(n)] += 1
        cost = np.array([[rng.randrange(0, 9) for _ in range(n)] for _ in range(m)], dtype=float)
        flow = resharding.min_cost_flow(supply, demand, cost)
        assert (flow >= 0).all() and flow.sum(axis=1).tolist() == supply and flow.sum(axis=0).tolist() == demand
        # no cycle of the residual graph is negative: Floyd-Warshall over sources and sinks
        d = np.full((m + n, m + n), np.inf)
        d[:m, m:] = cost
        d[m:, :m] = np.where(flow > 0, -cost, np.inf).T
        for k in range(m + n):
            d = np.minimum(d, d[:, k:k + 1] + d[k:k + 1, :])
        assert (np.diag(d) > -1e-9).all()
    with pytest.raises(ValueError):
        resharding.min_cost_flow([1], [2], np.zeros((1, 1)))


def test_levels_are_as_equal_as_can_be():
    assert resharding.levels([0, 0, 9], 7) == [4, 3, 0]
    assert resharding.levels([5, 1, 3], 0) == [0, 0, 0]
    assert resharding.levels([5, 1, 3], 6) == [0, 4, 2]
    assert resharding.levels([2], 5) == [5]


def check_shards(rows, got, shards):
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    load, slots = Counter(dict.fromkeys(range(shards), 0)), defaultdict(list)
    for r in got:
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(load) == shards
    return load


@pytest.mark.parametrize(("old", "new"), [(7, 10), (10, 4)])
def test_bytes_are_near_equal_and_few_move(spark, old, new):
    rng = random.Random(old)
    rows = [(i, "é" * rng.randrange(0, 300)) for i in range(4000)] + [(5000 + i, "b" * 20_000) for i in range(9)]
    rows += [(9000, "same row")] * 50 + [(None, None)] * 20
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    hot = F.when(F.col("doc_id") % 3 == 0, 0).otherwise(F.col("doc_id") % old)  # a third of the rows in one shard, some in none
    got = resharding.reshard(df, hot, new).collect()
    load = check_shards(rows, got, new)
    total = sum(load.values())
    assert max(load.values()) - min(load.values()) < 0.03 * total / new
    held = Counter()
    for r in got:
        held[r.old_shard] += r["size"]
    least = sum(b - min(b, total / new) if 0 <= j < new else b for j, b in held.items())
    assert sum(r["size"] for r in got if r.shard != r.old_shard) < 1.03 * least


def test_resharding_on_odd_rows(spark):
    got = resharding.reshard(frames.odd_docs(spark, CLASH), F.lit(None), 40).collect()
    check_shards(frames.odd_rows(), got, 40)
    assert len(got) == len(frames.odd_rows()) and all(r.old_shard == -1 for r in got)
    assert resharding.reshard(frames.empty_docs(spark), F.lit(0), 4).count() == 0
    equal = resharding.reshard(spark.createDataFrame([(i, "x" * 84) for i in range(400)], "doc_id long, text string"), F.col("doc_id") % 4, 4)
    assert equal.where("shard <> old_shard").count() == 0 and set(equal.groupBy("shard").count().select("count").toPandas()["count"]) == {100}


def test_only_affected_folders_are_rewritten(spark, tmp_path):
    rows = [(i, f"text {i} " + "y" * (i % 50), j, i) for j, n in enumerate([100, 100, 100, 300]) for i in range(1000 * j, 1000 * j + n)]
    path = str(tmp_path / "table")
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int, extra int")
    df.write.partitionBy("shard").parquet(path)
    files = {j: sorted(p.name for p in (tmp_path / "table" / f"shard={j}").iterdir()) for j in range(4)}
    assert resharding.rewrite_shards(spark, path, 4).collect()
    table = spark.read.parquet(path)
    assert Counter((r.doc_id, r.text, r.extra) for r in table.collect()) == Counter((i, t, x) for i, t, _, x in rows)
    again = resharding.rewrite_shards(spark, path, 3)  # shard 3 is dissolved
    assert {r.old_shard for r in again.collect()} >= {3} and not (tmp_path / "table" / "shard=3").exists()
    table = spark.read.parquet(path)
    assert table.count() == len(rows) and {r.shard for r in table.select("shard").distinct().collect()} == {0, 1, 2}
    load = [r.b for r in table.groupBy("shard").agg(F.sum(F.octet_length("text") + 16).alias("b")).collect()]
    assert max(load) - min(load) < 500
    files = {j: sorted(p.name for p in (tmp_path / "table" / f"shard={j}").iterdir()) for j in range(3)}
    moved = resharding.rewrite_shards(spark, path, 3).collect()
    touched = {j for r in moved for j in (r.old_shard, r.shard)}
    for j in set(range(3)) - touched:
        assert files[j] == sorted(p.name for p in (tmp_path / "table" / f"shard={j}").iterdir())


# --- conversation repair

STEPS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
FULL = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest, turns) by a search over (cost, audit)."""
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, faults = set(), []
    for _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, out = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
            return (gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, digest), out
        if (i, last) in done:
            continue
        done.add((i, last))
        options = [("I", 2, i, r, (FULL[r], "")) for r in "ua"]
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last, out))
            if faults[i] not in ("b", "d"):
                extra = int(faults[i] == "t")
                options.append(("K", extra, i + 1, role[:1], (role, text)))
                options += [("R", 2 + extra, i + 1, r, (FULL[r], text)) for r in "ua"]
        for edit, more, to, r, line in options:
            if (last, r) in STEPS:
                heapq.heappush(heap, (cost + more, audit + edit, to, r, (*out, line)))
    raise AssertionError


def by_turn(rows):
    return sorted(rows, key=lambda r: ((0, 0) if r[0] is None else (1, r[0]), r[1].encode(), r[2].encode()))


def told(x):
    return " " if x is None else str(x)


def repaired(rows):
    kept = defaultdict(list)
    for conv, turn, role, text in rows:
        kept[conv] += []
        k, role, text = zlib.crc32(f"{told(conv)}:{told(turn)}".encode()) % 20, told(role), told(text)
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            kept[conv] += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return {c: cheapest(by_turn(v))[0] for c, v in kept.items()}


def odd_turns():
    rng = random.Random(1)
    rows = [(c, rng.choice([i, i, i, None]), rng.choice(["user", "assistant", "system", None, "tool", "", "uber"]), rng.choice(["Hi.", "Yes", "No!", "", " \t", None, f"a{i}.", f"b{i}", "é" * 2000]))
            for c in [*range(60), None] for i in range(rng.randrange(0, 40))]
    rows += [(1000, i // 2, rng.choice(["user", "assistant", "system", "assistant"]), rng.choice(["Hi.", f"x{i}.", f"y{i}"])) for i in range(1500)]
    return rows + [(2000, 1, "user", "same?")] * 30 + [(2001, None, "user", "a.")] * 3


@pytest.mark.parametrize("least", [3, 64])
def test_repairs_equal_a_search(spark, monkeypatch, least):
    monkeypatch.setattr(repair, "LEAST_BLOCK", least)
    rows = odd_turns()
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4))
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair_conversations(df).collect()}
    want = repaired(rows)
    assert set(got) == set(want)
    for c in want:
        assert got[c] == want[c], c


def test_repaired_turns_are_well_formed(spark):
    rows = odd_turns()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    out = defaultdict(list)
    for r in repair.repaired_turns(df).collect():
        out[r.conv_id].append((tuple(r.k), r.role, r.text))
    given = defaultdict(list)
    for conv, turn, role, text in rows:
        given[conv].append((turn, told(role), told(text)))
    for conv, turns in given.items():
        lines = [(role, text) for _, role, text in sorted(out.get(conv, []))]
        assert lines == list(cheapest(by_turn(turns))[1])
        assert re.fullmatch("(s?(ua)+)?", "".join(role[:1] for role, _ in lines))


def test_repairs_of_the_table_and_of_none(spark):
    turns = spark.read.parquet(f"{frames.SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    got = {r.conv_id: tuple(r)[1:] for r in repair.op13_conversation_repair(spark, frames.SF).collect()}
    assert got == repaired([tuple(r) for r in turns.collect()])
    none = turns.limit(0)
    assert repair.repair_conversations(none).count() == repair.repaired_turns(none).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    lost = repair.repair_conversations(spark.createDataFrame([(gone, 0, "user", "x")], turns.schema)).collect()
    assert [tuple(r) for r in lost] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
