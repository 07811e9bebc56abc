"""Benchmark decontamination: a broadcast hash set of normalised benchmark n-grams.

Windows of consecutive benchmark words are hashed once on the driver, in blocks of a
bounded number of bytes, and broadcast. Documents are scanned in numpy over the raw
Arrow buffer; each hash hit is verified against the window's words before it counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_TABLE, Scratch, map_arrow, positional, prefix_hash, range_hash, shingle_hashes, text_slices, word_spans

WINDOW, MIN_ITEMS = 8, 2
BLOCK_BYTES = 16 << 20  # benchmark text broadcast at once; a larger benchmark is scanned in several blocks

#: Separators of the normal form: everything below 0x80 but digits and lower-case letters (after lower-casing).
WORD_SEP = np.zeros(256, bool)
WORD_SEP[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


def _words(data: np.ndarray, offs: np.ndarray):
    s, e, doc = word_spans(data, offs, WORD_SEP)
    return range_hash(prefix_hash(data), s, e), s, e, doc


def build_windows(items: list[tuple[str, str | None]], size: int) -> dict:
    """{window length: (sorted hashes, texts, item numbers)} of the items' windows, and the item names."""
    texts = [(t or "").encode() for _, t in items]
    data = LOWER_TABLE[np.frombuffer(b"".join(texts), np.uint8)]
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    h, s, e, doc = _words(data, offs)
    raw = data.tobytes()
    grouped: dict[int, dict] = {}
    first = np.searchsorted(doc, np.arange(len(items) + 1))
    for i in range(len(items)):
        a, b = int(first[i]), int(first[i + 1])
        m = min(size, b - a)
        if m == 0:
            continue
        hs, _ = shingle_hashes(h[a:b], doc[a:b], m)
        own = grouped.setdefault(m, {})
        for k, x in enumerate(hs.tolist()):
            words = b" ".join(raw[s[j] : e[j]] for j in range(a + k, a + k + m))
            own.setdefault((x, words), set()).add(i)
    out = {}
    for m, own in grouped.items():
        keys = sorted(own)
        out[m] = (np.array([k[0] for k in keys], np.uint64), [k[1] for k in keys], [sorted(own[k]) for k in keys])
    return {"windows": out, "items": [str(i) for i, _ in items]}


def _scan(data: np.ndarray, offs: np.ndarray, built: dict):
    """Word spans and, per document, hit word ranges and item names."""
    data = LOWER_TABLE[data]
    h, s, e, doc = _words(data, offs)
    hits: list[tuple[int, int, int]] = []  # (document, first word, words)
    found: dict[int, set] = {}
    for m, (keys, texts, items) in built["windows"].items():
        if len(h) < m:
            continue
        out = np.full(len(h) - m + 1, m, np.uint64)
        hs, _ = shingle_hashes(h, np.zeros(len(h), np.int64), m)
        ok = doc[: len(out)] == doc[m - 1 :]
        at = np.minimum(np.searchsorted(keys, hs), len(keys) - 1)
        for p in np.flatnonzero(ok & (keys[at] == hs)).tolist():
            words = b" ".join(data[s[j] : e[j]].tobytes() for j in range(p, p + m))
            k = int(at[p])
            while k < len(keys) and keys[k] == hs[p]:
                if texts[k] == words:
                    d = int(doc[p])
                    hits.append((d, p, m))
                    found.setdefault(d, set()).update(built["items"][i] for i in items[k])
                k += 1
    return s, e, doc, hits, found


def scan(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, hit_spans (array of word ranges [from, to)) and hit_items (sorted names).

    Null texts have no words. A benchmark item of fewer than ``size`` words is one window; an
    item without words never matches, nor does one with a null id. Items repeated under one
    id count once. An empty benchmark hits nothing. Columns of the same names as the three new ones are replaced.
    A benchmark above ``block_bytes`` is scanned block by block, each block's result written before the next.
    """
    spark = docs.sparkSession
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("item_id IS NOT NULL")
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    keep = docs.drop("n_words", "hit_spans", "hit_items")
    if blocks == 1:
        return _scan_block(keep, bench.collect(), size)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    out, tmp = None, Scratch(spark, "decontaminate")
    for b in range(blocks):
        rows = bench.filter(block == b).collect()
        prev = out
        out = _scan_block(keep if prev is None else prev.withColumnsRenamed({"n_words": "_nw", "hit_spans": "_hs", "hit_items": "_hi"}), rows, size)
        if prev is not None:
            out = out.withColumn("hit_spans", F.array_union("_hs", "hit_spans")).withColumn("hit_items", F.array_sort(F.array_union("_hi", "hit_items"))).drop("_nw", "_hs", "_hi")
        if b < blocks - 1:  # one block's windows in memory at a time
            out, done = tmp.write(out, "block"), prev
            if done is not None:
                tmp.drop(done)
    return out


def _merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _scan_block(docs: DataFrame, rows: list, size: int) -> DataFrame:
    built = build_windows([(r[0], r[1]) for r in rows], size)
    shared = docs.sparkSession.sparkContext.broadcast(built)
    span = "array<struct<from:int,to:int>>"
    fields = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    spans_type = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))

    def run(batches):
        own = shared.value
        for batch in batches:
            n = batch.num_rows
            n_words = np.zeros(n, np.int64)
            spans: list = [[]] * n
            names: list = [[]] * n
            for first, data, offs in text_slices(batch):
                s, _, doc, hits, found = _scan(data, offs, own)
                k = len(offs) - 1
                n_words[first : first + k] = np.bincount(doc, minlength=k)
                start = np.searchsorted(doc, np.arange(k))
                per: dict[int, list] = {}
                for d, p, m in hits:
                    per.setdefault(d, []).append((p - int(start[d]), p - int(start[d]) + m))
                for d, r in per.items():
                    spans[first + d] = [{"from": a, "to": b} for a, b in _merge(r)]
                    names[first + d] = sorted(found[d])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n_words), pa.array(spans, spans_type), pa.array(names, pa.list_(pa.string()))], names=[*batch.schema.names, "n_words", "hit_spans", "hit_items"])

    return map_arrow(docs, run, ", ".join([*fields, "n_words long", f"hit_spans {span}", "hit_items array<string>"]))


def _n_hit(spans):
    """Words in the union of ranges (ranges of several blocks may overlap)."""
    step = F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["to"] - F.greatest(x["from"], acc["end"]))).cast("long").alias("n"), F.greatest(acc["end"], x["to"]).alias("end")),
    )
    return step["n"]


def contamination(docs: DataFrame, benchmark: DataFrame, min_items: int = MIN_ITEMS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, hit_items, contaminated for each row of ``docs`` (doc_id, text)."""
    s = scan(docs.select("doc_id", "text"), benchmark)
    return s.select("doc_id", "n_words", _n_hit("hit_spans").alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), "hit_items", (F.size("hit_items") >= min_items).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_items: int = MIN_ITEMS) -> DataFrame:
    """The rows of ``docs`` in which fewer than ``min_items`` benchmark items occur."""
    plain, back = positional(docs)
    return back(scan(plain, benchmark).filter(F.size("hit_items") < min_items))


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with the hit words cut out of the text (with the separators between them)."""
    plain, back = positional(docs)
    s = scan(plain, benchmark)
    cols = plain.columns
    at = cols.index("text")

    def cut(batches):
        for b in batches:
            spans = b.column(b.schema.get_field_index("hit_spans")).to_pylist()
            texts = b.column(at).to_pylist()
            for i, own in enumerate(spans):
                if own:
                    raw = texts[i].encode()
                    data = np.frombuffer(raw, np.uint8)
                    ws, we, _ = word_spans(LOWER_TABLE[data], np.array([0, len(data)]), WORD_SEP)
                    out, last = [], 0
                    for r in own:
                        out.append(raw[last : ws[r["from"]]])
                        last = we[r["to"] - 1]
                    texts[i] = b"".join([*out, raw[last:]]).decode()
            arrays = [pa.array(texts, pa.string()) if j == at else b.column(j) for j in range(len(cols))]
            yield pa.RecordBatch.from_arrays(arrays, names=list(cols))

    return back(map_arrow(s, cut, plain.schema))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    c = contamination(docs, bench)
    sha = F.sha2(F.array_join("hit_items", ",").cast("binary"), 256)
    return c.select("doc_id", "n_words", "n_hit", "n_items", sha.alias("items_sha256"), "contaminated")



_WORDS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP6_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_WORDS_SQL} AS w FROM benchmark),
bm AS (SELECT item, w, least({WINDOW}, len(w)) AS m FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, m, array_to_string(w[i : i + m - 1], ' ') AS g FROM bm, unnest(range(1, len(w) - m + 2)) AS t(i)),
dw AS (SELECT doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS g FROM d, (SELECT DISTINCT m FROM bw) AS l, unnest(range(1, len(w) - m + 2)) AS t(i)),
hits AS (SELECT doc_id, i, m, item FROM dw JOIN bw USING (m, g)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + m)) AS u(p) GROUP BY doc_id),
k AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= {MIN_ITEMS} AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""
