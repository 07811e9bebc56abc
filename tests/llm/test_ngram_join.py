"""The n-gram join against a comparison of all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from palimpsest.llm.ngram_join import keep_one, link

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_force(docs, n, percent):
    sets = [(d, shingles(t, n)) for d, t in docs]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = {}
    for i, (_, s) in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    pairs = {(i, j) for m in where.values() for a, i in enumerate(m) for j in m[a + 1 :]}
    for i, j in pairs:
        a, b = sets[i][1], sets[j][1]
        k = len(a & b)
        if 100 * k >= percent * (len(a) + len(b) - k):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        r = find(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return sorted(((d, len(s), least[find(i)]) for i, (d, s) in enumerate(sets)), key=str)


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


@pytest.mark.parametrize("n,percent,frequent", [(4, 85, None), (5, 80, 3.0), (4, 60, 2.0)])
def test_whole_table(spark, sf, n, percent, frequent):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want = brute_force([tuple(r) for r in docs.collect()], n, percent)
    assert rows(link(docs, n, percent, frequent)) == want
    assert any(d != c for d, _, c in want)


def test_near_copies_with_common_words(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    base = [[rng.choice(words) for _ in range(k)] for k in (6, 7, 20, 60, 200)]
    docs = []
    for i in range(240):
        b = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            b[rng.randrange(len(b))] = rng.choice(words)
        docs.append((i, " ".join(b)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(link(df, 2, 80, 0.0)) == brute_force(docs, 2, 80)
    assert rows(link(df, 2, 80)) == brute_force(docs, 2, 80)


def test_edges(spark):
    long = " ".join(f"t{i}" for i in range(30000))
    docs = [(7, None), (8, ""), (9, "  \n"), (1, "Two words"), (2, "two WORDS"), (2, "other text altogether here now ok"), (3, long), (4, long + " tail"), (None, "two words"), (None, "nobody else has these words here"), (5, "one"), (5, "one")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"sid": F.lit("clash"), "key": F.lit(1), "root": F.lit(None)})
    assert rows(link(df, 4, 85)) == brute_force(docs, 4, 85)
    assert link(df.limit(0), 4, 85).count() == 0
    kept = keep_one(df, 4, 85)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "2", "3", "5", "5", "7", "8", "9", "None", "None"]
