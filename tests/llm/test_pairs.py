"""Packing, suffix dedup, MinHash near-dedup and the pipeline against brute force and on odd input."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import minhash, packing, suffix_dedup
from tests.llm import frames

CLASH = ("rep", "bucket", "bands", "n", "size", "part", "local", "ids", "__doc", "__crc", "ranges", "first", "component_id")


@lru_cache(maxsize=1)
def _tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@lru_cache(maxsize=1000)
def _ids(text):
    return np.array([*_tokenizer().encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")


@pytest.mark.parametrize("window", [1024, 64])
def test_packing_is_a_gapless_partition(spark, window):
    rows = frames.odd_rows()
    seqs = packing.pack(frames.odd_docs(spark, CLASH), window=window)
    kept = seqs.collect()
    assert sorted(s.sequence_id for s in kept) == list(range(len(kept)))
    assert all(len(s.ids) == 4 * window for s in kept) and all(s.n_tokens == window for s in kept if s.sequence_id < len(kept) - 1)
    total = sum(len(_ids(r[1])) for r in rows)
    assert sum(s.n_tokens for s in kept) == total and len(kept) == -(-total // window)
    stream = defaultdict(list)
    for s in sorted(kept, key=lambda s: s.sequence_id):
        at = 0
        for p in s.pieces:
            assert p.offset == at
            stream[p.doc_id].append((p.start, bytes(s.ids[4 * at:4 * (at + p.length)]), p.doc_tokens))
            at += p.length
        assert at == s.n_tokens and not any(s.ids[4 * at:])
    want = defaultdict(list)
    for i, t, *_ in rows:
        want[i].append(_ids(t).tobytes())
    for i, pieces in stream.items():
        texts, now = [], b""
        for start, raw, n in pieces:
            assert start == len(now) // 4
            now += raw
            if len(now) == 4 * n:
                texts.append(now)
                now = b""
        assert Counter(texts) == Counter(want[i])
    for r in packing.piece_rows(seqs).where("doc_id = 15").collect():
        ids = _ids(next(t for i, t, *_ in rows if i == 15))
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())


def test_quick_encoder_equals_the_tokenizer():
    rng = random.Random(6)
    bits = ["a", "É", "ß", " ", " ", "　", "漢", "\U0001f600", "'s", "'S", " ", "  ", "\n", "\t", "\r\n", "12", "³", "ª", "_", "<|endoftext|>", "\x00", "\x85", "ɏ", "ǅ", "̀"]
    encode = packing.encoder("byte_bpe_50k")
    for _ in range(1500):
        text = "".join(rng.choices(bits, k=rng.randrange(1, 20)))
        assert [*encode(text), 0] == _ids(text).tolist(), repr(text)
    assert encode("x <|endoftext|> y") == _tokenizer().encode("x <|endoftext|> y", add_special_tokens=False).ids and 50256 in encode("x <|endoftext|> y")


def test_quick_encoder_equals_the_tokenizer_on_all_texts_of_the_table():
    import duckdb
    encode = packing.encoder("byte_bpe_50k")
    texts = [t or "" for t, in duckdb.sql(f"select text from '{frames.SF.replace('0.001', '0.1')}/documents.parquet'").fetchall()]
    assert len(texts) == 10_000
    for at in range(0, len(texts), 500):
        whole = _tokenizer().encode_batch(texts[at:at + 500], add_special_tokens=False)
        assert all(encode(t) == e.ids for t, e in zip(texts[at:at + 500], whole, strict=True))


@pytest.mark.parametrize(("length", "kgram", "most"), [(200, 64, 4096), (40, 16, 4096), (40, 16, 2)])
def test_repeated_bytes_are_exactly_removed(spark, length, kgram, most):
    rng = random.Random(length + most)
    passage = frames.sentence(rng, 60)
    rows = [r[:2] for r in frames.odd_rows() if r[0] not in (15,)]
    rows += [(400 + i, frames.sentence(rng, 20) + passage[:rng.randrange(len(passage))] + frames.sentence(rng, 10)) for i in range(30)]
    rows += [(500 + i, "".join(rng.choice("ab") for _ in range(300)) + "é" * 60) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for c in CLASH:
        df = df.selectExpr("*", f"'x' as {c}")
    got = Counter((r.doc_id, bytes(r.kept), r.n_bytes, r.n_removed, tuple(map(tuple, r.spans)))
                  for r in suffix_dedup.remove_repeats(df, length=length, kgram=kgram, most=most).collect())
    want = Counter()
    for (i, _), (raw, cover) in zip(rows, frames.repeated_bytes([t for _, t in rows], length), strict=True):
        edges = [k for k in range(len(raw) + 1) if (k > 0 and cover[k - 1]) != (k < len(raw) and cover[k])]
        spans = tuple(zip(edges[::2], edges[1::2], strict=True))
        want[i, bytes(c for c, x in zip(raw, cover, strict=True) if not x), len(raw), sum(cover), spans] += 1
    assert got == want


def test_anchors_cut_long_texts_into_segments(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 64)
    data = np.frombuffer(("ab" * 60 + "xyz" * 50).encode(), dtype=np.uint8)
    winnow = suffix_dedup.Anchors(40, 16)
    starts = []
    for at in range(0, len(data) - 39, 64):
        first, n, place, _ = winnow.runs(data[at:at + 64 + 39])
        for a, k, p in zip(first, n, place, strict=True):
            starts += range(at + a, at + a + k)
            assert a + k - 1 <= p <= a + 40 - 16  # in every window of the run
    assert starts == list(range(len(data) - 39))


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(8)
    base = frames.sentence(rng, 150).split()
    rows = [r[:2] for r in frames.odd_rows() if r[0] is not None]
    for i in range(120):  # mutations around the threshold
        w = list(base)
        for _ in range(rng.randrange(0, 12)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10 ** 6)}"
        rows.append((1000 + i, " ".join(w)))
    rows += [(2000 + i, " ".join(frames.sentence(rng, 5).split()[:n])) for i, n in enumerate([1, 1, 2, 3, 4, 4, 5, 5])]
    df = spark.createDataFrame([*rows, (None, " ".join(base)), (None, "all alone here"), (None, None)], "doc_id long, text string").repartition(3)
    for c in CLASH:
        df = df.selectExpr("*", f"'x' as {c}")
    got = minhash.near_duplicates(df).collect()
    want = frames.near_components(sorted(set(rows), key=lambda r: r[0]))
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    null = {(r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is None}
    assert (0, None, True) in null and len(got) == len(rows) + 3
    assert {r.doc_id for r in minhash.near_dedup(df).where("doc_id is not null").collect()} == {i for i, (_, c) in want.items() if i == c}


def test_blocks_of_a_large_bucket_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 7)
    monkeypatch.setattr(minhash, "NEED_LEADER", 99)  # leave everything to the blocks
    test_near_duplicates_equal_brute_force(spark)


def test_coinciding_hashes_and_salted_pairs_hide_no_link(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PAIRS", 3)
    narrow = minhash.token_sets

    def coinciding(docs, kind="<u4"):
        sets = narrow(docs, kind)
        if kind == "<u8":
            return sets
        alike = F.expr("cast(repeat('same', cast(length(tokens) / 4 as int)) as binary)")  # every set like any other of its size
        return sets.withColumn("tokens", alike)

    monkeypatch.setattr(minhash, "token_sets", coinciding)
    monkeypatch.setattr(minhash, "NEED_LEADER", 99)
    test_near_duplicates_equal_brute_force(spark)


def test_super_minhash_estimates_similarity():
    rng = np.random.default_rng(3)
    for n, both in ((40, 30), (300, 150), (3000, 2700)):
        errors = []
        for _ in range(40):
            pool = rng.integers(0, 2 ** 63, 2 * n - both, dtype=np.uint64)
            sig = minhash.super_minhash([np.unique(pool[:n]), np.unique(pool[n - both:])])
            errors.append((sig[0] == sig[1]).mean() - both / (2 * n - both))
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05
    one = minhash.super_minhash([np.array([5], dtype=np.uint64)])[0]
    assert sorted((one >> np.uint64(32)).tolist()) == list(range(minhash.PLACES))  # one element: a permutation of all ranks


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(0, 300)]
    star = [(1000, 1001 + i) for i in range(200)]
    edges = [(b, a) if rng.random() < 0.5 else (a, b) for a, b in chain + star + [(5000, 5000 - 2), (7, 7)]]
    rng.shuffle(edges)
    got = {r.node: r.component for r in minhash.components(spark.createDataFrame(edges, "u long, v long").repartition(6)).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, **{1001 + i: 1000 for i in range(200)}, 5000: 4998}


def test_empty_tables(spark):
    docs = frames.empty_docs(spark)
    assert packing.pack(docs).count() == packing.piece_rows(packing.pack(docs)).count() == 0
    assert suffix_dedup.remove_repeats(docs).count() == 0
    assert minhash.near_duplicates(docs).count() == minhash.near_dedup(docs).count() == 0


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline
    from tessera.llm.common import scratch
    for docs in (frames.odd_docs(spark, CLASH), frames.empty_docs(spark)):
        columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
        for name, stage in corpus_pipeline.STAGES:
            before = docs.count()
            docs = scratch(stage(spark, docs, frames.SF), f"test-{name}")
            if name != "packing":
                assert docs.columns == columns and docs.count() <= before and {r.doc_id for r in docs.collect()} <= ids
                assert docs.where("n_chars is not null and text is null").count() == 0 or name == "quality_rules"
        assert docs.count() >= (1 if ids else 0)


def test_pipeline_runs_over_the_tables(spark):
    import corpus_pipeline
    out = corpus_pipeline.run(spark, frames.SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{frames.SF}/documents.parquet").collect()}
    used = {p.doc_id for s in out for p in s.pieces}
    assert used and used <= set(docs)
    kept = {i for i in used if frames.base_statistics(docs[i].text)[0] >= 20}
    assert kept == used
    assert len({hashlib.md5(docs[i].text.lower().encode()).digest() for i in used}) == len(used)
