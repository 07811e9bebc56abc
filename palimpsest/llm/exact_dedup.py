"""Exact duplicates by deterministic block naming (DataFrame functions only).

Texts are cut into fixed-size byte blocks. Distinct blocks are sorted and numbered; a
document then is a short string of integers. Adjacent integers are paired, distinct
pairs are sorted and numbered again, and so on until one integer is left for each
document. Two documents have the same (level, integer) exactly when their texts are
equal. A 64-bit hash routes blocks to their names; blocks that share a hash are found
and renamed by their bytes, so a collision never merges two texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower

BLOCK_BYTES = 4096


def _numbered(df: DataFrame, *keys: str) -> DataFrame:
    """Sort distinct keys and number them; a number is unique over all partitions."""
    return df.select(*keys).distinct().sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES, route_bits: int = 64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    ``docs`` needs doc_id and text; other columns are ignored, whatever their names.
    Null text counts as empty and empty texts are equal to each other. Of equal texts the
    row with the largest doc_id stays; rows that repeat both doc_id and text share one
    fate and all count in group_size. A null doc_id is never preferred over another id; a
    group of null ids only keeps them (keep_id null). An empty table gives no rows.

    Shuffles: each distinct block once (after map-side distinct), then 8-byte names only.
    """
    spark: SparkSession = docs.sparkSession
    tmp = Scratch(spark, "blocknames")
    norm = docs.select("doc_id", ascii_lower(F.coalesce(F.col("text"), F.lit(""))).cast("binary").alias("b"))
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("b") / block_bytes)).cast("int")
    # doc_id alone may repeat: the row key is (doc_id, length, hash of the text)
    keyed = norm.select("doc_id", F.octet_length("b").alias("len"), F.xxhash64("b").alias("th"), n.alias("nb"), "b")
    key = ["doc_id", "len", "th"]
    blocks = keyed.select(
        *key, "nb", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda i: F.substring(F.col("b"), i * block_bytes + 1, F.lit(block_bytes)))).alias("pos", "block")
    )
    h = F.xxhash64("block") if route_bits >= 64 else F.pmod(F.xxhash64("block"), F.lit(1 << route_bits))
    blocks = blocks.withColumn("h", h)

    names = tmp.write(_numbered(blocks, "h", "block").select("h", "name"), "names")
    clash = tmp.write(names.groupBy("h").count().filter("count > 1").select("h"), "clash")
    if clash.isEmpty():
        cur = blocks.drop("block").join(names, "h").drop("h")
    else:
        free = blocks.drop("block").join(clash, "h", "left_anti").join(names, "h").drop("h")
        by_bytes = tmp.write(blocks.join(clash, "h", "left_semi"), "by_bytes")
        renamed = _numbered(by_bytes, "h", "block").withColumn("name", -2 - F.col("name"))
        cur = free.unionByName(by_bytes.join(renamed, ["h", "block"]).drop("h", "block"))
    cur = tmp.write(cur, "level0")
    done = [cur.filter("nb = 1").select(*key, F.lit(0).alias("level"), "name")]
    longest = cur.agg(F.max("nb")).first()[0] or 1
    level, cur = 0, cur.filter("nb > 1")
    while longest > 1:
        level, longest = level + 1, (longest + 1) // 2
        half = F.shiftright("pos", 1)
        even = F.col("pos") % 2 == 0
        pairs = cur.groupBy(*key, ((F.col("nb") + 1) / 2).cast("int").alias("nb"), half.alias("pos")).agg(F.max(F.when(even, F.col("name"))).alias("l"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("r"))
        pairs = tmp.write(pairs, f"pairs{level}")
        cur = tmp.write(pairs.join(_numbered(pairs, "l", "r"), ["l", "r"]).drop("l", "r"), f"level{level}")
        done.append(cur.filter("nb = 1").select(*key, F.lit(level).alias("level"), "name"))
        cur = cur.filter("nb > 1")
    ident = done[0]
    for d in done[1:]:
        ident = ident.unionByName(d)
    ident = ident.dropDuplicates(key)
    rows = keyed.select(*key, F.sha2("b", 256).alias("text_sha256")).alias("r")
    same = (F.col("r.doc_id").eqNullSafe(F.col("i.doc_id"))) & (F.col("r.len") == F.col("i.len")) & (F.col("r.th") == F.col("i.th"))
    named = tmp.write(rows.join(ident.alias("i"), same).select("r.doc_id", "level", "name", "text_sha256"), "identities")
    # written, so that the join below has an exchange on both sides and a large group can be split
    groups = tmp.write(named.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    return named.join(groups, ["level", "name"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
