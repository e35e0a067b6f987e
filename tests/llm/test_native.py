"""Chat formatting, exact dedup, quality rules, mixing and line dedup against brute force and on odd input."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, exact_dedup, line_dedup, mixing, quality_rules
from tests.llm import frames

CLASH = ("h", "sha", "norm", "size", "pos", "n", "tokens", "topic", "keep_id", "kept", "runs", "lines", "n_words", "__words")


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_exact_groups_on_odd_rows(spark):
    rows = frames.odd_rows()
    got = exact_dedup.exact_groups(frames.odd_docs(spark, CLASH)).collect()
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[frames.ascii_lower(t)].append(i)
    want = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, keep, len(ids), i == keep, _sha(t)] += 1
    assert Counter(map(tuple, got)) == want


def test_exact_dedup_keeps_one_text_each(spark):
    docs = frames.odd_docs(spark, CLASH).where("doc_id is not null").dropDuplicates(["doc_id"])
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns
    texts = [frames.ascii_lower(r.text) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({frames.ascii_lower(r.text) for r in docs.collect()})
    assert exact_dedup.exact_dedup(docs, keep="min").where("doc_id = 6").count() == 1


def test_line_dedup_against_brute_force(spark):
    rows = [r for r in frames.odd_rows() if r[0] is not None]
    got = {r.doc_id: r for r in line_dedup.line_dedup(frames.odd_docs(spark, CLASH)).where("doc_id is not null").collect()}
    seen = {}
    for i, t, *_ in sorted({r[:2] for r in rows}, key=lambda r: r[0]):
        lines = (t or "").split("\n")
        gone = set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p:p + 3])
            if frames.words(" ".join(w)) and seen.setdefault(w, (i, p)) != (i, p):
                gone |= {p, p + 1, p + 2}
        want = t if not gone else "\n".join(x for k, x in enumerate(lines) if k not in gone)
        runs = sum(k - 1 not in gone for k in gone)
        assert (got[i].text, got[i].n_lines, got[i].n_removed_lines, got[i].n_runs) == (want, len(lines), len(gone), runs), i
    assert got[12].n_removed_lines == 12 and got[11].n_removed_lines == 0


def test_line_dedup_keeps_columns_rows_and_null_ids(spark):
    docs = frames.odd_docs(spark, CLASH)
    out = line_dedup.line_dedup(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed_lines", "n_runs"]
    assert out.count() == docs.count() and out.where("doc_id is null and n_removed_lines > 0").count() == 0


def test_quality_base_statistics(spark):
    got = quality_rules.text_statistics(frames.odd_docs(spark, ("__hashes", "__at"))).collect()
    want = Counter((r[0], *frames.base_statistics(r[1])) for r in frames.odd_rows())
    assert Counter((r.doc_id, *[r[c] for c in quality_rules.BASE]) for r in got) == want


def test_quality_window_overlaps(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("ab") for _ in range(n)) for n in (7, 8, 9, 16, 40, 200)]
    texts += [frames.sentence(rng, 20) + " " + " ".join("abcdefghij") + " " + frames.sentence(rng, 9) + " " + " ".join("abcdefghij")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.text_statistics(df).collect()}
    assert got == {i: frames.base_statistics(t)[4] for i, t in enumerate(texts)}


def _mcd(x, floor):
    """Concentration steps in numpy from two starts with the same floors, on exactly the nearest documents, to the end."""
    low, middle, high = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    best = None
    for centre, scatter in ((middle, np.diag(((high - low) / 1.349) ** 2 + floor ** 2)), (x.mean(axis=0), np.cov(x.T, bias=True) + np.diag(floor ** 2))):
        for _ in range(100):
            d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(scatter), x - centre)
            near = x[d <= np.sort(d)[int(np.ceil(len(x) * quality_rules.SUPPORT)) - 1]]
            centre, before = near.mean(axis=0), np.linalg.det(scatter)
            scatter = quality_rules.CONSISTENT * np.cov(near.T, bias=True) + np.diag(floor ** 2)
            if np.linalg.det(scatter) >= before:
                break
        if best is None or np.linalg.det(scatter) < best[0]:
            best = np.linalg.det(scatter), centre, scatter
    return best[1:]


def _vector(r):
    n, chars, symbols, equal, repeat = (r[c] for c in quality_rules.BASE)
    return [np.sqrt(symbols / max(chars, 1)), np.sqrt(equal / max(r.n_lines, 1)), np.sqrt(repeat / n), np.log((chars + 500) / (n + 100))]


def _with_repeats(rng, share):
    """A text of which about ``share`` of the words lie in a passage of eight words found twice."""
    n = rng.randrange(150, 400)
    passage = frames.sentence(rng, 8, 10 ** 6)
    times = max(2, round(share * n / 8))
    return " ".join([frames.sentence(rng, n - 8 * times), *[f"{passage} k{i}" for i in range(times)]])


def test_chi_square_values():
    assert quality_rules.chi_square_quantile(0.999, 4) == pytest.approx(18.4668, abs=1e-3)
    assert quality_rules.chi_square_quantile(0.75, 4) == pytest.approx(5.3853, abs=1e-3)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200_000, 4))
    near = x[np.argsort((x ** 2).sum(axis=1))[:150_000]]
    assert quality_rules.CONSISTENT * near.var() == pytest.approx(1, abs=0.02)


def test_quality_outliers_follow_minimum_covariance_determinant(spark):
    rng = random.Random(9)
    rows = [(i, frames.sentence(rng, rng.randrange(150, 400)), "en", "a" if i % 3 else "b", 0) for i in range(900)]
    rows += [(900 + i, "\n".join([*[frames.sentence(rng, 20) for _ in range(11)], "once more"] + ["once more"] * (i % 2)), "en", "a", 0) for i in range(40)]  # some repeat a line in twelve
    planted = {
        "symbols": lambda: " ".join(w + "$" * rng.randrange(1, 3) for w in frames.sentence(rng, 200).split()),
        "lines": lambda: "\n".join([frames.sentence(rng, 30) for _ in range(8)] + ["say it again"] * 8),
        "repeats": lambda: _with_repeats(rng, 0.26),
        "length": lambda: frames.sentence(rng, 300).replace(" ", "yyyyy "),
    }
    kinds = {}
    for name, make in planted.items():
        for _ in range(20):
            kinds[1000 + len(kinds)] = name
            rows.append((999 + len(kinds), make(), "en", "a", 0))
    rows += [(3000 + i, " ".join(w + "%%" for w in frames.sentence(rng, 200).split()), "en", "b", 0) for i in range(80)]  # a fifth of its pair
    docs = spark.createDataFrame(rows, frames.SCHEMA)
    got = {r.doc_id: r for r in quality_rules.quality_verdicts(docs).collect()}
    assert len(got) == len(rows) and not any(r.base_failed for r in got.values())
    for i, name in kinds.items():
        assert not got[i].kept, (name, got[i])
    assert not any(got[i].kept for i in got if i >= 3000)
    assert sum(got[i].kept for i in got if i < 1000) >= 0.99 * 940
    floor = np.array([quality_rules.FLOOR[d] for d in quality_rules.DIMS])
    for source in "ab":
        ids = [r[0] for r in rows if r[3] == source]
        x = np.array([_vector(got[i]) for i in ids])
        centre, scatter = _mcd(x, floor)
        d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(scatter), x - centre)
        told = np.array([got[i].distance2 for i in ids])
        assert np.corrcoef(d, told)[0, 1] > 0.999
        sure = np.abs(d / quality_rules.CUTOFF - 1) > 0.1  # bins round distances
        assert ((d <= quality_rules.CUTOFF) == np.array([got[i].kept for i in ids]))[sure].all() and sure.mean() > 0.98


def test_quality_filter_on_odd_rows(spark):
    docs = frames.odd_docs(spark, CLASH)
    told = quality_rules.quality_verdicts(docs)
    assert told.count() == docs.count()
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept) for r in told.collect())
    kept = quality_rules.quality_filter(docs)
    assert kept.columns == docs.columns and {6, 7, 100} <= {r.doc_id for r in kept.collect()}


def _targets(own, asked, keep):
    """Water-filling by bisection."""
    cap = {k: min(1, max(v, mixing.ROOM * v / keep)) for k, v in own.items()}
    low, high = 0.0, 1e9
    for _ in range(300):
        c = (low + high) / 2
        low, high = (c, high) if sum(min(cap[k], c * asked[k]) for k in own) < 1 else (low, c)
    return {k: min(cap[k], low * asked[k]) for k in own}


def _rake(cells, targets, keep, sweeps=400):
    """Cell probabilities under the bound 1: every level's factor by bisection, one level after the other."""
    factor = [dict.fromkeys(t, 1.0) for t in targets]

    def given(k):
        return min(1.0, keep * factor[0][k[0]] * factor[1][k[1]] * factor[2][k[2]])

    for _ in range(sweeps):
        for a in range(3):
            for level, want in targets[a].items():
                mine = [k for k in cells if k[a] == level]
                low, high = 0.0, 1e6
                for _ in range(100):
                    factor[a][level] = (low + high) / 2
                    low, high = (factor[a][level], high) if sum(given(k) * cells[k] for k in mine) < want * keep else (low, factor[a][level])
    return {k: given(k) for k in cells}


def _mixed(seed, rare):
    """Documents of three languages and two sources, and a language with about ``rare`` of the tokens."""
    rng = random.Random(seed)
    rows = [(i, frames.sentence(rng, rng.choice([30, 150, 400])), rng.choice(["en", "en", "de", "fr"]), rng.choice("aaaab"), 0) for i in range(600)]
    total = sum(len(frames.words(r[1])) for r in rows)
    return [*rows, (9000, frames.sentence(rng, max(1, round(rare * total))), "xx", "a", 0)], total


@pytest.mark.parametrize("wanted", [{}, {"lang": {"en": 0.4, "de": 0.3}, "source": {"a": 0.7, "b": 0.3}}])
def test_mixing_probabilities_match_proportional_fitting(spark, wanted):
    rows, total = _mixed(2, 1e-3)
    docs = spark.createDataFrame(rows, frames.SCHEMA)
    got = mixing.mixing_weights(docs, wanted).collect()
    cells, own = Counter(), [Counter(), Counter(), Counter()]
    for r in got:
        assert r.tokens == len(frames.words(rows[r.doc_id if r.doc_id < 9000 else -1][1])) and r.topic == ("short" if r.tokens < 100 else "prose")
        for a, name in enumerate(mixing.ATTRS):
            own[a][r[name]] += r.tokens
        cells[r.source, r.lang, r.topic] += r.tokens
    total = sum(cells.values())
    cells = {k: v / total for k, v in cells.items()}
    targets = []
    for a, name in enumerate(mixing.ATTRS):
        mine = {k: v / total for k, v in own[a].items()}
        if name in wanted:
            free = {k: v for k, v in mine.items() if k not in wanted[name]}
            spare = 1 - sum(wanted[name].values())
            asked = {**{k: v for k, v in wanted[name].items()}, **{k: spare * v / sum(free.values()) for k, v in free.items()}}
        else:
            asked = {k: v ** mixing.ALPHA for k, v in mine.items()}
        targets.append(_targets(mine, asked, mixing.KEEP))
    want = _rake(cells, targets, mixing.KEEP)
    for r in got:
        assert r.probability == pytest.approx(want[r.source, r.lang, r.topic], rel=2e-3)
    assert sum(r.tokens * r.probability for r in got) == pytest.approx(mixing.KEEP * total, rel=1e-3)
    for a, name in enumerate(mixing.ATTRS):
        assert _shares(got, name) == pytest.approx(targets[a], rel=1e-3)
    kept = sum(r.kept for r in got)
    assert abs(kept - sum(r.probability for r in got)) < 60 and kept == mixing.mix(docs, targets=wanted).count()


def _shares(rows, level):
    mass = Counter()
    for r in rows:
        mass[r[level]] += r.tokens * r.probability
    return {k: v / sum(mass.values()) for k, v in mass.items()}


@pytest.mark.parametrize("rare", [1e-2, 1e-6])
def test_a_rare_level_does_not_shrink_the_sample(spark, rare):
    """One word in a million, and one in a hundred: the sample has half of the tokens."""
    cells = [("a", "en", "prose", 600_000, 6000), ("a", "de", "short", 250_000, 900), ("b", "en", "short", 90_000, 90), ("b", "de", "prose", 60_000, 10),
             ("a", "xx", "table", round(rare * 1e6), 1)]
    cells = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long, docs long")
    raked, report, held = mixing.rake_within(cells, {})
    told = raked.collect()
    assert held == pytest.approx(mixing.KEEP, rel=1e-3)
    assert sum(r.tokens * r.probability for r in told) / sum(r.tokens for r in told) == pytest.approx(mixing.KEEP, rel=1e-3)
    levels = {(r.attr, r.level): r for r in report.collect()}
    assert len(levels) == 8 and all(r.gap < 1e-3 for r in levels.values())
    assert levels["topic", "table"].target <= levels["topic", "table"].own / mixing.KEEP


def test_many_cells_are_swept_alike(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FEW_CELLS", 0)
    test_a_rare_level_does_not_shrink_the_sample(spark, 1e-2)


def test_mixing_tells_of_wishes_that_cannot_be_met(spark):
    docs = spark.createDataFrame([(i, "one two three", "en" if i % 2 else "de", "a" if i % 2 else "b", 0) for i in range(20)], frames.SCHEMA)
    with pytest.warns(UserWarning, match="not all wanted shares"):
        got = mixing.mixing_weights(docs, {"lang": {"en": 0.3, "de": 0.7}, "source": {"a": 0.6, "b": 0.4}}).collect()
    assert sum(r.probability * r.tokens for r in got) == pytest.approx(30, rel=1e-3)
    with pytest.warns(UserWarning, match="not all wanted shares"):
        report = mixing.mixing_report(docs, {"lang": {"en": 1.0}}, keep=0.8).collect()
    assert {r.level: (round(r.asked, 3), round(r.share, 3)) for r in report if r.attr == "lang"}["en"][0] == 1.0


def test_mixing_on_odd_rows(spark):
    docs = frames.odd_docs(spark, CLASH)
    got = mixing.mixing_weights(docs).collect()
    assert len(got) == docs.count() and all(0 < r.probability <= 1 for r in got)
    assert all(r.kept and r.topic == "empty" for r in got if r.tokens == 0) and {r.doc_id for r in got if r.tokens == 0} == {1, 2, 3}
    out = mixing.mix(docs)
    assert out.columns == docs.columns and out.count() == sum(r.kept for r in got)
    own = mixing.mixing_weights(docs, topic_col="topic")
    assert {r.topic for r in own.collect()} == {"clash"}


def _fold(log):
    state = []
    for seq, kind, msg, role, text in log:
        at = next((i for i, m in enumerate(state) if msg is not None and m[0] == msg), None)
        if at is None or kind not in ("delta", "edit", "regenerate"):
            state.append([msg, role or "", text or ""])
        elif kind == "delta":
            state[at][2] += text or ""
        else:
            state[at][2] = text or ""
            if kind == "regenerate":
                state = state[:at + 1]
    return [(m[1], m[2]) for m in state]


def test_chat_folds_events(spark):
    log = [(0, "message", "a", "user", "hi"), (1, "message", "b", "assistant", "He"), (2, "delta", "b", None, "llo"), (3, "message", "c", "user", "more"),
           (4, "message", "d", "assistant", "ok"), (5, "regenerate", "b", None, ""), (6, "delta", "b", None, "Hey"), (7, "edit", "a", None, "hi there"),
           (8, "delta", "z", "assistant", "new"), (9, None, None, "user", None), (10, "message", None, "user", "x"), (11, "odd", "q", "tool", "y")]
    rows = [(5, *e) for e in random.Random(1).sample(log, len(log))] + [(None, 1, "message", None, None, None)]
    out = {r.conv_id: [(m.role, m.text) for m in r.messages]
           for r in chat.fold_events(spark.createDataFrame(rows, "conv_id long, seq long, kind string, msg string, role string, text string")).collect()}
    assert out[5] == _fold(log) and out[5][:2] == [("user", "hi there"), ("assistant", "Hey")]
    assert out[None] == [("", "")]


def test_chat_folds_random_logs(spark):
    rng = random.Random(8)
    logs = {c: [(i, rng.choice(["message", "delta", "delta", "edit", "regenerate" if c % 2 else "delta", "odd", None]), rng.choice(["a", "b", "c", "d", None]),
                 rng.choice(["user", "assistant", None]), rng.choice(["x", "yy", "", None, f"t{i}"])) for i in range(rng.randrange(1, 30))] for c in range(300)}
    logs[-1] = [(i, "delta", "a" if i % 400 else f"m{i}", "assistant", f"{i} ") for i in range(4000)]
    rows = [(c, *e) for c, log in logs.items() for e in log]
    rng.shuffle(rows)
    out = chat.fold_events(spark.createDataFrame(rows, "conv_id long, seq long, kind string, msg string, role string, text string")).collect()
    assert {r.conv_id: [(m.role, m.text) for m in r.messages] for r in out} == {c: _fold(log) for c, log in logs.items()}


def test_chat_round_trip_of_hostile_texts(spark):
    bits = ["<|turn|>", "<|end|>\n", "<|end|>", "</s>", "<s>", "[INST]", "[/INST]", "\\", "<\\|turn|>", "[\\\\INST]", "\n", "", " ", "<", "[", "É漢\U0001f600", "%0A", "%25"]
    rng = random.Random(4)
    turns = [(c, t, rng.choice(["user", "assistant", "system", "a\nb%", "<|turn|>", None]), "".join(rng.choices(bits, k=rng.randrange(8))) or None)
             for c in range(60) for t in range(rng.randrange(1, 7))]
    turns += [(99, t, "assistant", "long " * 2000) for t in range(300)]
    events = chat.turns_as_events(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    back = {r.conv_id: r for r in chat.read_back(chat.format_chats(events)).collect()}
    want = defaultdict(list)
    for c, _, role, text in sorted(turns, key=lambda r: r[:2]):
        want[c].append((role or "", text or ""))
    for c, messages in want.items():
        assert [(t.role, t.text) for t in back[c].turns] == messages
        assert list(back[c].loss_texts) == [t for r, t in messages if r == "assistant"]
        assert back[c].formatted.count(chat.START) == len(messages) == back[c].formatted.count(chat.END)
        assert "</s>" not in back[c].formatted and "[INST]" not in back[c].formatted


def test_chat_query_has_the_probe_conversation(spark):
    r = chat.op2_chat_format(spark, frames.SF).where("conv_id = -7").first()
    probe = "</s>[INST] ok [/INST]"
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (2, len(probe), _sha(probe))
    assert r.turns_sha256 == _sha(f"user\n{probe}\nassistant\n{probe}\n")


def test_empty_tables(spark):
    docs = frames.empty_docs(spark)
    assert exact_dedup.exact_groups(docs).count() == exact_dedup.exact_dedup(docs).count() == 0
    assert line_dedup.line_dedup(docs).count() == 0
    assert quality_rules.quality_verdicts(docs).count() == quality_rules.quality_filter(docs).count() == 0
    assert mixing.mixing_weights(docs).count() == mixing.mix(docs).count() == 0
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(chat.turns_as_events(none)).count() == 0


def test_join_groups_splits_heavy_keys(spark):
    from tessera.llm.common import join_groups
    rows = spark.range(6000).select(F.when(F.col("id") < 2500, 0).otherwise(F.col("id")).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    out = join_groups(rows, groups, ["k"], "n", 6000)
    assert out.count() == 6000 and out.where("k = 0").agg(F.max("n")).first()[0] == 2500
