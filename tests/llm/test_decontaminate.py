"""Benchmark decontamination against a plain reading of its contract."""

import hashlib
import re

from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import decontaminate as dc

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))


def brute_force(docs, items, size=8, min_items=2):
    wins = {}
    for i, t in items:
        w = words(t)
        m = min(size, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            wins.setdefault(tuple(w[k : k + m]), set()).add(str(i))
    lengths = {len(x) for x in wins}
    out = []
    for d, t in docs:
        w = words(t)
        hit, own = set(), set()
        for m in lengths:
            for k in range(len(w) - m + 1):
                if got := wins.get(tuple(w[k : k + m])):
                    own |= got
                    hit.update(range(k, k + m))
        out.append((d, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), len(own) >= min_items))
    return sorted(out, key=str)


def digest(df):
    sha = F.sha2(F.array_join("hit_items", ",").cast("binary"), 256)
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", sha, "contaminated").collect()), key=str)


def test_whole_table(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = brute_force([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in bench.collect()])
    got = sorted((tuple(r) for r in dc.op6_decontamination(spark, sf).collect()), key=str)
    assert got == want
    assert sum(x[2] for x in got) > 0


DOCS = [
    (1, "x one two three four five six seven eight nine ten y", None, None, None),
    (2, "ONE two, three FOUR five six seven\u00a0eight", "en", "s", 1),
    (3, None, None, None, None),
    (4, "", None, None, None),
    (5, "short item here; short item here, " * 3000, None, None, None),
    (5, "short item here", None, None, None),
    (None, "caf\u00e9 TEST one", None, None, None),
]
ITEMS = [(10, "one two three four five six seven eight nine ten"), (11, "short item"), (12, "item here"), (13, None), (14, " ,;"), (15, "caf\u00e9 test"), (11, "short item")]
NULL_ITEM = [(None, "one two three four five six seven eight")]


def test_edges_and_blocks(spark):
    docs = spark.createDataFrame(DOCS, SCHEMA).withColumn("n_words", F.lit("clash"))
    bench = spark.createDataFrame(ITEMS + NULL_ITEM, "item_id long, text string").withColumn("hit_items", F.lit(1))
    want = brute_force([(r[0], r[1]) for r in DOCS], ITEMS)
    assert digest(dc.contamination(docs, bench)) == want
    s = dc.scan(docs.select("doc_id", "text"), bench, block_bytes=20)
    got = s.select("doc_id", "n_words", dc._n_hit("hit_spans"), F.size("hit_items"), F.sha2(F.array_join("hit_items", ",").cast("binary"), 256), F.size("hit_items") >= 2)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    kept = dc.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4]
    cut = {r.doc_id: r.text for r in dc.remove_spans(docs.filter("doc_id <= 2"), bench).collect()}
    assert cut[1] == "x  y"


def test_pipeline_stage_drops_one_item(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = brute_force([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in bench.collect()])
    clean = sorted(x[0] for x in want if x[3] == 0)
    assert 0 < len(clean) < docs.count()
    kept = corpus_pipeline.decontamination(spark, docs, sf)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == clean


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert dc.contamination(docs.limit(0), bench).count() == 0
    assert dc.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0
