"""Jaccard self-join of documents on word n-grams, with token-combination prefixes.

Distinct word n-grams are a document's tokens. Tokens are ordered by corpus frequency,
rare first, and fall into a rare class and a frequent class. A prefix is extended until
removing the tokens in which two similar sets may differ still leaves, for the rare
class, one token, or for a subclass of the frequent class, a pair: rare tokens are
indexed singly, frequent ones as pairs within subclasses. Documents that share a
signature are verified on their whole sets.

Why no link is lost: sets x, y with 100*|x&y| >= p*|x|y| have |x-y| <= e = |x| - ceil(p|x|/100).
If a prefix has r rare tokens and n_s tokens of frequent subclass s with
r + sum(max(0, n_s - 1)) > e, then after striking any e tokens a rare token or a pair of
one subclass is left, and of the two prefixes the one that ends first lies, as far as
shared, within the other. The number of subclasses depends on the size class; sizes of
linked sets are at most one class apart, so each set is indexed for its own class and the
next.

Frequencies come from a count sketch of fixed size over all documents. It only decides
order and class, never a result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_TABLE, Scratch, free_shuffles, group_arrow, map_arrow, mix, packed, positional, shingle_hashes, sum_vectors, text_slices, word_hashes
from .components import components

SKETCH_BITS, PIECES = 20, 16
BITMAP_BYTES, ID_BITS = 256, 57
BLOCK, BUCKET_ROWS = 1024, 20_000  # members of a star compared at once; rows of a task
BROADCAST_IDS = 500_000  # ids of candidates are broadcast up to this many, else joined by shuffle


def _sets(data: np.ndarray, offs: np.ndarray, n: int):
    """(hash, document) of the distinct n-grams, ordered by document and hash; a shorter text is one n-gram."""
    h, doc, _, _ = word_hashes(LOWER_TABLE[data], offs)
    sh, sd = shingle_hashes(h, doc, n)
    count = np.bincount(doc, minlength=len(offs) - 1)
    few = np.flatnonzero((count > 0) & (count < n))
    if len(few):
        start = np.searchsorted(doc, few)
        whole = np.array([int(shingle_hashes(h[a : a + c], np.zeros(c, np.int64), c)[0][0]) for a, c in zip(start.tolist(), count[few].tolist())], np.uint64)
        sh, sd = np.concatenate([sh, whole]), np.concatenate([sd, few])
    order = np.lexsort((sh, sd))
    sh, sd = sh[order], sd[order]
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (sd[1:] != sd[:-1])
    return sh[new], sd[new]


def _identities(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """57-bit identity of each set, whatever the order of its members; at: borders of the sets."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(h))])
    return (mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(7)).view(np.int64)


def _cells(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << SKETCH_BITS) - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(SKETCH_BITS)) & mask).astype(np.int64)


def _sketch(docs: DataFrame, n: int) -> np.ndarray:
    """Two rows of counters over the n-grams of all documents: fixed size, summed in a tree."""
    size = 1 << SKETCH_BITS

    def count(batches):
        acc = np.zeros((2, size), np.int64)
        wait: list = []

        def add():
            h = np.concatenate(wait)
            for k, c in enumerate(_cells(h)):
                acc[k] += np.bincount(c, minlength=size)
            wait.clear()

        for b in batches:
            for _, data, offs in text_slices(b):
                wait.append(_sets(data, offs, n)[0])
                if sum(map(len, wait)) > 2 * size:
                    add()
        if wait:
            add()
        part = TaskContext.get().partitionId()
        flat = acc.reshape(PIECES, -1)
        yield pa.RecordBatch.from_arrays([pa.array([part] * PIECES, pa.int32()), pa.array(range(PIECES), pa.int32()), pa.array([packed(x) for x in flat], pa.binary())], names=["part", "piece", "cells"])

    got = sum_vectors(map_arrow(docs.select("text"), count, "part int, piece int, cells binary"), "sketch")
    if not got:
        return np.zeros((2, size), np.int32)
    return np.minimum(np.concatenate([got[i] for i in range(PIECES)]), 2**31 - 1).astype(np.int32).reshape(2, size)


def _slack(size: int, percent: int) -> int:
    return size - -(-percent * size // 100)


def _pair_signatures(tokens: np.ndarray, need: int, size: int, percent: int) -> np.ndarray:
    """Pairs of frequent tokens (in global order) for the size class of the set and the next."""
    own = math.floor(math.log(size) / -math.log(percent / 100) + 1e-9)
    out = []
    for g in (own, own + 1):
        subclasses = max(1, _slack(int((100 / percent) ** g), percent) // 4)
        sub = (mix(tokens + np.uint64(g)) % np.uint64(subclasses)).astype(np.int64)
        members: dict[int, list[int]] = {}
        left = need
        for t, s in zip(tokens.tolist(), sub.tolist()):
            seen = members.setdefault(s, [])
            if seen:
                left -= 1
            seen.append(t)
            if left <= 0:
                break
        pairs = [(a, b) for m in members.values() for i, a in enumerate(m) for b in m[:i]]
        if pairs:
            p = np.array(pairs, np.uint64)
            lo, hi = p.min(axis=1), p.max(axis=1)
            out.append(mix(mix(lo + np.uint64(g + 1)) * np.uint64(0x9DDFEA08EB382D69) + hi))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _signatures(docs: DataFrame, n: int, percent: int, frequent: float | None = None) -> DataFrame:
    """key, n_shingles, sid (identity of the set), bits (parity bitmap of the set), sigs."""
    spark = docs.sparkSession
    sketch = _sketch(docs, n)
    load = float(sketch[0].mean())
    frequent = load + 64 + 6 * math.sqrt(load + 1) if frequent is None else frequent  # above the noise of the sketch
    noise = load + 4 * math.sqrt(load + 1)
    shared = spark.sparkContext.broadcast(sketch)

    def run(batches):
        counts = shared.value
        for b in batches:
            size, sids, bits, sigs = [], [], [], []
            for _, data, offs in text_slices(b):
                h, d = _sets(data, offs, n)
                k = len(offs) - 1
                a, c = _cells(h)
                est = np.minimum(counts[0][a], counts[1][c])
                order = np.lexsort((h, est, d))
                ordered, rare = h[order], est[order] <= frequent
                at = np.searchsorted(d, np.arange(k + 1))
                # the high bits order sets by their share of shared tokens: the least of near copies is the one they derive from
                common = np.concatenate([[0], np.cumsum(est > noise)])
                share = (common[at[1:]] - common[at[:-1]]) / np.maximum(np.diff(at), 1)
                sids += (_identities(h, at) | ((63 - (63 * share).astype(np.int64)) << ID_BITS)).tolist()
                size += np.diff(at).tolist()
                cell = (mix(h) >> np.uint64(53)).astype(np.int64)  # 2048 bits
                for i in range(k):
                    s, e = int(at[i]), int(at[i + 1])
                    parity = np.bincount(cell[s:e], minlength=8 * BITMAP_BYTES) & 1
                    bits.append(np.packbits(parity.astype(bool)).tobytes())
                    if s == e:
                        sigs.append(np.zeros(0, np.uint64))
                        continue
                    need = _slack(e - s, percent) + 1
                    r = int(np.count_nonzero(rare[s:e]))
                    own = ordered[s : s + min(need, r)]
                    if r < need:
                        own = np.concatenate([own, _pair_signatures(ordered[s + r : e], need - r, e - s, percent)])
                    sigs.append(own)
            lens = np.concatenate([[0], np.cumsum([len(x) for x in sigs])]).astype(np.int32)
            flat = np.concatenate(sigs).view(np.int64) if sigs else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size, pa.int32()), pa.array(sids, pa.int64()), pa.array(bits, pa.binary()), pa.ListArray.from_arrays(pa.array(lens), pa.array(flat))],
                names=["key", "n_shingles", "sid", "bits", "sigs"],
            )

    return map_arrow(docs.select(F.col("doc_id").alias("key"), "text"), run, f"key {docs.schema['doc_id'].dataType.simpleString()}, n_shingles int, sid long, bits binary, sigs array<long>")


def _token_sets(docs: DataFrame, n: int) -> DataFrame:
    """id, tokens of each text; within a task each set once."""

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            for _, data, offs in text_slices(b):
                h, d = _sets(data, offs, n)
                at = np.searchsorted(d, np.arange(len(offs)))
                ids = _identities(h, at)
                new = []
                for k in ids.tolist():
                    new.append(k not in seen)
                    seen.add(k)
                keep = pa.array(new)
                sets = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(ids).filter(keep), sets.filter(keep)], names=["id", "tokens"])

    return map_arrow(docs, run, "id long, tokens array<long>")


def _near(size_a, size_b, bits_a: np.ndarray, bits_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets may be similar by their sizes and parity bitmaps.

    The number of differing bits is at most the size of the symmetric difference, so a pair
    struck out here can't be similar.
    """
    both = size_a + size_b
    most = (both - np.bitwise_count(bits_a ^ bits_b).sum(axis=1).astype(np.int64)) // 2  # of the intersection
    return 100 * most >= percent * (both - most)


def _bits(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _sift(pairs: DataFrame, info: DataFrame, percent: int, tmp: Scratch) -> DataFrame:
    """The pairs (a, b) that sizes and bitmaps leave."""
    # sizes go first: they are small to move and strike out most pairs before bitmaps are joined
    a, b = (info.select(F.col("sid").alias(x), F.col("n").alias(f"n{x}")) for x in "ab")
    sized = pairs.join(a, "a").join(b, "b").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    sized = tmp.write(sized, "sized")
    a, b = (info.select(F.col("sid").alias(x), F.col("bits").alias(f"bits_{x}")) for x in "ab")
    sized = sized.join(a, "a").join(b, "b")

    def near(batches):
        for x in batches:
            if x.num_rows:
                na, nb = (np.asarray(x.column(i)).astype(np.int64) for i in (2, 3))
                ok = pa.array(_near(na, nb, _bits(x.column(4)), _bits(x.column(5)), percent))
                yield pa.RecordBatch.from_arrays([x.column(0).filter(ok), x.column(1).filter(ok)], names=["a", "b"])

    return map_arrow(sized.select("a", "b", "na", "nb", "bits_a", "bits_b"), near, "a long, b long")


def _compare_stars(members: DataFrame, percent: int, tmp: Scratch) -> DataFrame:
    """Pairs (a, b) of one star and different components that sizes and bitmaps leave.

    ``members``: star, sid, root, n, bits. A star of more than BLOCK members is compared block
    against block, each pair of blocks a unit of its own, so no task holds a whole star.
    """
    rows = members.count()
    count = tmp.write(members.groupBy("star").agg((F.ceil(F.count("*") / BLOCK)).cast("int").alias("nb")), "blocks")  # written: a large star can then be split in the join
    cut = members.join(count, "star").withColumn("own", F.pmod(F.xxhash64("sid"), F.col("nb")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    unit = cut.select("star", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "sid", "root", "n", "bits")
    unit = unit.withColumn("bucket", F.pmod(F.xxhash64("star", "i", "j"), F.lit(max(1, -(-rows // BUCKET_ROWS)))))

    def run(t: pa.Table) -> pa.Table:
        star, i, j, own, sid, root, n = (np.asarray(t.column(c)).astype(np.int64) for c in ("star", "i", "j", "own", "sid", "root", "n"))
        bits = _bits(t.column("bits").combine_chunks())
        order = np.lexsort((sid, j, i, star))
        new = np.ones(len(order), bool)
        for k, c in enumerate((star, i, j)):
            c = c[order]
            new[1:] = (c[1:] != c[:-1]) if k == 0 else new[1:] | (c[1:] != c[:-1])
        at = np.append(np.flatnonzero(new), len(order))
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
            g = order[s:e]
            left, right = g[own[g] == i[g[0]]], g[own[g] == j[g[0]]]
            same = i[g[0]] == j[g[0]]
            for k, x in enumerate(left.tolist()):
                y = right[k + 1 :] if same else right
                y = y[(root[y] != root[x]) & (100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x]))]
                if len(y):
                    y = y[_near(n[y], n[x], bits[y], bits[x], percent)]
                    out.append((np.full(len(y), sid[x]), sid[y]))
        a, b = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in (0, 1))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return group_arrow(unit.groupBy("bucket"), run, "a long, b long")


def _verify(close: DataFrame, info: DataFrame, docs: DataFrame, n: int, percent: int, tmp: Scratch) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar.

    Sets are read again from the texts of the candidates only, and each side of a pair is
    joined with the sets that have that role.
    """
    low = lambda c: F.col(c).bitwiseAND(F.lit((1 << ID_BITS) - 1))
    close = tmp.write(close.distinct(), "close")
    roles = close.select(F.explode(F.array(F.struct(F.col("a").alias("sid"), F.lit(1).alias("role")), F.struct(F.col("b").alias("sid"), F.lit(2).alias("role")))).alias("x")).groupBy("x.sid").agg(F.bit_or("x.role").alias("role"))
    ids = tmp.write(info.join(roles, "sid").select("rep", low("sid").alias("id"), "role"), "ids")
    small = ids.count() <= BROADCAST_IDS
    some = lambda df: F.broadcast(df) if small else df
    reps = ids.select("rep").distinct()
    texts = docs.join(some(reps), docs["doc_id"].eqNullSafe(reps["rep"]), "left_semi").select("text")
    sets = tmp.write(_token_sets(texts, n).join(some(ids.select("id", "role")), "id"), "tokens")
    x, y = (sets.filter(F.col("role").bitwiseAND(F.lit(r)) != 0).select(F.col("id").alias(f"id_{s}"), F.col("tokens").alias(f"t{s}")) for r, s in ((1, "a"), (2, "b")))
    both = close.withColumns({"id_a": low("a"), "id_b": low("b")}).join(y, "id_b").join(x, "id_a").withColumn("i", F.size(F.array_intersect("ta", "tb")))
    return both.filter(100 * F.col("i") >= percent * (F.size("ta") + F.size("tb") - F.col("i"))).select("a", "b").distinct()


def link(docs: DataFrame, n: int = 5, percent: int = 80, frequent: float | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs`` (doc_id, text).

    A document's tokens are its distinct n-word sequences after lower-casing A-Z; with fewer
    words the whole sequence is one token; without words it has none and is linked with
    nothing (its component is its own id). component_id is the least doc_id of the documents
    reached by links of Jaccard similarity ``percent``/100 at least. Texts with one set are
    one node; sets are told apart by 57 bits of a hash over their n-grams, so that two different
    ones are taken as one with a chance of about (number of sets)**2 / 2**58. Very long texts
    are hashed whole; of ``docs`` only doc_id and text are read, whatever other columns are
    called. Rows that repeat a doc_id get each their own text's component. Rows with a null
    doc_id take part; a component of such rows only has a null id.

    Sets that share a signature form a star around the one with the most tokens in common
    with the corpus, and are compared with it. What is left, members of one star in different
    components, is compared by bitmaps in blocks of a star, once for all signatures of the
    star; no pair is emitted before it has passed.
    """
    if not 60 <= percent <= 100:
        raise ValueError("percent must be 60 to 100")
    spark = docs.sparkSession
    tmp = Scratch(spark, "ngramjoin")
    table = tmp.write(_signatures(docs, n, percent, frequent), "signatures")
    full = table.filter("n_shingles > 0")
    info = tmp.write(full.groupBy("sid").agg(F.min("key").alias("rep"), F.first("n_shingles").alias("n"), F.first("bits").alias("bits")), "sets")
    rows = full.select("sid", F.explode("sigs").alias("sig"))
    # written, so that the join has an exchange on both sides and a frequent signature can be split
    shared = tmp.write(rows.groupBy("sig").agg(F.min("sid").alias("star"), F.max("sid").alias("last")).filter("star <> last").select("sig", "star"), "shared")
    free_shuffles(spark)
    star = tmp.write(rows.join(shared, "sig").select("star", "sid").distinct(), "stars")
    slim = tmp.write(table.select("key", "n_shingles", "sid"), "identities")
    tmp.drop(table)
    tmp.drop(shared)
    free_shuffles(spark)
    pairs = star.filter("sid <> star").select(F.col("star").alias("a"), F.col("sid").alias("b"))
    linked = tmp.write(_verify(_sift(pairs, info, percent, tmp), info, docs, n, percent, tmp), "linked")
    free_shuffles(spark)
    comp = tmp.write(components(linked, tmp), "comp")
    free_shuffles(spark)
    placed = tmp.write(star.join(comp.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid")), "placed")
    # pairs with the star's centre are decided; the rest of a star is compared where its members lie in several components
    open_ = tmp.write(placed.filter("sid <> star").groupBy("star").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("star"), "open")
    members = tmp.write(placed.filter("sid <> star").join(open_, "star", "left_semi").join(info.select("sid", "n", "bits"), "sid"), "members")
    cross = _compare_stars(members, percent, tmp).distinct()
    more = tmp.write(_verify(cross, info, docs, n, percent, tmp), "more")
    comp = tmp.write(components(linked.unionByName(more), tmp), "comp")
    member = slim.filter("n_shingles > 0").select("key", "sid").join(comp.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    least = tmp.write(member.groupBy("root").agg(F.min("key").alias("component_id")), "least")
    named = slim.join(comp.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid")).join(least, "root", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("key"))
    return named.select(F.col("key").alias("doc_id"), F.col("n_shingles").cast("long").alias("n_shingles"), own.alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that are the first (least doc_id) of their component.

    Rows with a null doc_id stay. Rows that repeat a kept doc_id stay with it.
    """
    tmp = Scratch(docs.sparkSession, "keepone")
    kept = tmp.write(link(docs, n, percent).filter("doc_id = component_id").select(F.col("doc_id").alias("_keep")).distinct(), "kept")
    kept = F.broadcast(kept) if kept.count() <= BROADCAST_IDS else kept
    plain, back = positional(docs, keep=("text", "doc_id"))
    return back(plain.filter("doc_id IS NULL").unionByName(plain.join(kept, plain["doc_id"] == kept["_keep"], "left_semi")))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), n=4, percent=85)


OP3_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT doc_id, coalesce(n, 0) AS n_shingles, c AS component_id
FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY a) USING (doc_id)
"""
