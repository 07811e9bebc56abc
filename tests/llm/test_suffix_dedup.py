"""Repeated strings against a table of all strings of the length."""

import hashlib
import random

from pyspark.sql import functions as F

from palimpsest.llm.suffix_dedup import COVERS, repeats


def brute_force(docs, length):
    raw = [(d, (t or "").encode()) for d, t in docs]
    seen = {}
    for _, b in raw:
        for p in range(len(b) - length + 1):
            k = hash(b[p : p + length])
            seen[k] = seen.get(k, 0) + 1
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[hash(b[p : p + length])] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def test_covers():
    for v, d in COVERS.items():
        assert sorted((a - b) % v for a in d for b in d if a != b) == list(range(1, v))


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want = brute_force([tuple(r) for r in docs.collect()], 400)
    assert rows(repeats(docs)) == want
    assert any(r[2] for r in want)


def test_borders_of_near_copies(spark):
    rng = random.Random(3)
    text = lambda n, a="abcde ": "".join(rng.choice(a) for _ in range(n))
    base = [text(n) for n in (30, 60, 200, 900)]
    docs = []
    for i in range(60):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            t[rng.randrange(len(t))] = "ö"
        cut = rng.randrange(len(t))
        docs.append((i, text(rng.randrange(40)) + "".join(t[cut:]) + "".join(t[:cut])))
    docs += [(100, "z" * 700), (101, "xy" * 150), (102, None), (103, ""), (103, "short"), (None, base[3]), (104, base[3]), (104, base[3])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"chunk": F.lit("clash"), "data": F.lit(None)})
    got = repeats(df, length=48, period=7)
    assert rows(got) == brute_force(docs, 48)
    for r in got.filter("n_removed > 0").collect():
        assert len(r.kept) == r.n_bytes - r.n_removed and sum(s["to"] - s["from"] for s in r.spans) == r.n_removed
    assert repeats(df.limit(0)).count() == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("palimpsest_chunks")]


def test_shifted_copies(spark):
    """One passage at every shift, with more or less of it, so that every pair of residues occurs."""
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    base = text(130)
    docs = [(i, text(i) + base[rng.randrange(40) : 130 - rng.randrange(40)] + text(rng.randrange(9))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for period, length in ((7, 27), (7, 60), (13, 51), (21, 83)):
        assert rows(repeats(df, length=length, period=period)) == brute_force(docs, length)
