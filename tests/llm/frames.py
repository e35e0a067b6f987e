"""Small frames and brute-force versions for the corpus operators."""

from __future__ import annotations

import random
import re
from collections import Counter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}{'x' * rng.randrange(4)}" for _ in range(n))


def odd_rows(seed=3):
    """Nulls in every column, empty, blank, short and very long texts, ties, repeated rows, a clash of cases."""
    rng = random.Random(seed)
    base = sentence(rng, 120)
    lines = "\n".join(sentence(rng, 6) for _ in range(12))
    rows = [
        (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \t\n ", "en", None, 4), (4, "one two", None, "s", 7),
        (5, "One TWO", "en", "s", 7), (6, base, "en", "s", None), (7, base, "en", "hot", 1), (7, base, "en", "hot", 1),
        (8, base.upper(), "en", "hot", 1), (9, base + " tail", "de", "hot", 1), (10, "É" * 300 + " ß " + base, "fr", "hot", 2),
        (11, lines, "en", "hot", 3), (12, "head\n" + lines + "\nend", "en", "hot", 3), (13, lines + "\n" + lines, "en", "hot", 3),
        (14, "ab" * 400, "en", "hot", 1), (15, sentence(rng, 30000, 5000), "en", "hot", 9), (16, "x" * 5000, "es", "hot", 5000),
        (None, base, "en", "s", 1), (None, "no id here", "en", "s", 1), (17, "<|endoftext|> 漢字 \U0001f600 %0A", "zh", "s", 1),
    ]
    rows += [(100 + i, base, "en", "hot", 1) for i in range(40)]
    rows += [(200 + i, base + f" extra{i}", "en", "hot", 1) for i in range(40)]
    return rows


def odd_docs(spark, clash=()):
    """``odd_rows`` as a frame, with additional columns named ``clash``."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("clash") for c in clash})


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = words(ascii_lower(text))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_components(rows):
    """doc_id -> smallest reachable doc_id, over all pairs."""
    sets = {i: shingles(t) for i, t, *_ in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def repeated_bytes(texts, length):
    """Per text, whether each byte is covered by a string of ``length`` bytes that starts anywhere else."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        cover = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                cover[i:i + length] = [True] * length
        out.append((b, cover))
    return out


def base_statistics(text):
    w = words(text)
    windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    often = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
