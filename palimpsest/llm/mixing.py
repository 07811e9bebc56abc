"""Mixing sources to target weights by a Pfair schedule (DataFrame functions only).

Each source is cut into blocks of documents. Block i of a source with a of Q units of
weight is released at floor(i*Q/a) and due at ceil((i+1)*Q/a); earliest deadline first
fills one slot at a time. Q is so large that units stand for the weights themselves, and
the driver works out a slot for each block there is (three integers a block). While a
source lasts, each prefix of the mix is within one block of its target for that source.

With a short period Q given, weights are rounded to whole units of it and the schedule
repeats every Q slots: only one period is worked out, but prefixes are then within one
block of the rounded weights, and drift from the exact ones period by period. The SQL of
op9_mixing fixes a period of 1000 slots.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import positional

PERIOD, BLOCK_DOCS, TEMPERATURE, ROWS_PER_BUCKET = 1000, 16, 0.7, 20_000
FINE = 1 << 80  # units of exact weights
BROADCAST_BLOCKS = 4_000_000  # larger schedules are joined by shuffle


def units(weights: dict, period: int = PERIOD) -> dict:
    """Whole units that sum to the period (largest remainders, at least one for each source).

    With more sources than the period has slots the period grows to four slots a source.
    """
    period = period if len(weights) * 4 <= period else 4 * len(weights)
    total = sum(weights.values())
    exact = {s: period * w / total for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (-(exact[s] - int(exact[s])), s))
    k = 0
    while sum(out.values()) < period:
        out[order[k % len(order)]] += 1
        k += 1
    while sum(out.values()) > period:  # the minimum of one was paid for by the largest
        out[max(out, key=lambda s: (out[s], s))] -= 1
    return out


def schedule(unit: dict) -> list[tuple]:
    """(source, block of the period, slot) by earliest deadline first; ties go to the first name."""
    q = sum(unit.values())
    waiting = [(0, s, 0) for s in sorted(unit)]  # (release, source, block)
    heapq.heapify(waiting)
    ready: list[tuple] = []  # (deadline, source, block)
    out = []
    for t in range(q):
        while waiting and waiting[0][0] <= t:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * q // unit[s]), s, i))
        if ready:
            _, s, i = heapq.heappop(ready)
            out.append((s, i, t))
            heapq.heappush(waiting, ((i + 1) * q // unit[s], s, i + 1))
    return out


def exact_units(weights: dict) -> dict:
    """Whole units that sum to FINE; each is its weight but for one part in 2**80 of the sum."""
    total = sum(Fraction(w) for w in weights.values())
    out = {s: max(1, int(FINE * Fraction(w) / total)) for s, w in weights.items()}
    out[max(out, key=lambda s: (out[s], s))] += FINE - sum(out.values())
    return out


def slots(unit: dict, blocks: dict) -> dict:
    """{source: the slot of each of its blocks} by earliest deadline first, for a given number of blocks; ties go to the first name.

    A source that has ended takes no more slots, which leaves every other block its window.
    """
    q = sum(unit.values())
    waiting = [(0, s) for s in sorted(unit) if blocks[s]]  # (release, source)
    heapq.heapify(waiting)
    ready: list[tuple] = []  # (deadline, source)
    out: dict = {s: [] for s in unit}
    t = 0
    while waiting or ready:
        if not ready:
            t = max(t, waiting[0][0])
        while waiting and waiting[0][0] <= t:
            _, s = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(len(out[s]) + 1) * q // unit[s]), s))
        _, s = heapq.heappop(ready)
        out[s].append(t)
        if len(out[s]) < blocks[s]:
            heapq.heappush(waiting, (len(out[s]) * q // unit[s], s))
        t += 1
    return out


def _source(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), c), F.lit(""))  # null is a source of its own


def mix(docs: DataFrame, weights: dict | None = None, period: int | None = None, block_docs: int = BLOCK_DOCS, rows_per_bucket: int = ROWS_PER_BUCKET, key: str = "doc_id") -> DataFrame:
    """``docs`` with mix_block, mix_place (within the block) and mix_slot; order by slot, place.

    Every row is kept once. ``weights``: source -> positive number; default is the source's
    row count to the power 0.7. A source without a weight gets the least weight given. Rows
    with a null source are one source. Within a source, order is by md5 of the key as text
    (null last), then the key; rows with one key take adjacent places in any order. When a
    source ends, its slots stay empty or go to blocks that are due. Clashing columns: the
    three new ones replace their namesakes. Weights are exact unless a ``period`` is given.

    Row numbers within a source come from counts per (source, hash range), so no task ever
    holds a whole source.
    """
    spark = docs.sparkSession
    src, md = _source(F.col("source")), F.coalesce(F.md5(F.col(key).cast("string").cast("binary")), F.lit("g"))
    sizes = {r[0]: r[1] for r in docs.groupBy(src.alias("s")).count().collect()}
    given = {("" if s is None else f"={s}"): float(w) for s, w in weights.items()} if weights else {s: n**TEMPERATURE for s, n in sizes.items()}
    least = min(given.values(), default=1.0)
    target = {s: given.get(s, least) for s in sizes} or {"": 1.0}
    total = sum(sizes.values())
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")) * 4, -(-total // rows_per_bucket))
    bucket = F.coalesce(F.floor(F.conv(F.substring(md, 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)), F.lit(buckets)).cast("int")
    rows = docs.drop("mix_block", "mix_place", "mix_slot").withColumns({"_s": src, "_h": md, "_b": bucket})
    counts = docs.select(src.alias("_s"), bucket.alias("_b")).groupBy("_s", "_b").count()
    before = counts.select("_s", "_b", (F.sum("count").over(W.partitionBy("_s").orderBy("_b").rowsBetween(W.unboundedPreceding, 0)) - F.col("count")).alias("_before"))
    ranked = rows.withColumn("_rn", F.row_number().over(W.partitionBy("_s", "_b").orderBy("_h", key)) - 1).join(before, ["_s", "_b"])
    at = F.col("_rn") + F.col("_before")
    blocked = ranked.withColumns({"mix_block": F.floor(at / block_docs), "mix_place": (at % block_docs).cast("int")})
    if period is None:
        return _exact(blocked, target, {s: -(-n // block_docs) for s, n in sizes.items()} or {"": 0})
    unit = units(target, period)
    q = sum(unit.values())
    plan = spark.createDataFrame([(s, i, t, unit[s]) for s, i, t in schedule(unit)], "_s string, _k long, _t long, _a long")
    a = _of_source(unit)
    if a is None:
        blocked = blocked.join(F.broadcast(spark.createDataFrame(list(unit.items()), "_s string, _u long")), "_s")
        a = F.col("_u")
    blocked = blocked.withColumns({"_k": F.col("mix_block") % a, "_p": F.floor(F.col("mix_block") / a)})
    out = blocked.join(F.broadcast(plan), ["_s", "_k"])  # one period: q rows
    return out.withColumn("mix_slot", F.col("_p") * q + F.col("_t")).drop("_s", "_h", "_b", "_rn", "_before", "_k", "_p", "_t", "_a", "_u")


def _of_source(numbers: dict) -> Column | None:
    """The number of a row's source as an expression, when the sources are few."""
    return F.create_map(*[F.lit(x) for s, n in numbers.items() for x in (s, n)])[F.col("_s")] if len(numbers) <= 200 else None


def _exact(blocked: DataFrame, target: dict, blocks: dict) -> DataFrame:
    spark = blocked.sparkSession
    at = slots(exact_units(target), blocks)
    first, keys, n = {}, [], 0  # blocks are numbered through all sources
    for s in sorted(at):
        first[s] = n
        n += len(at[s])
        keys += at[s]
    plan = spark.createDataFrame(pa.table({"_k": pa.array(range(n), pa.int64()), "_t": pa.array(keys, pa.int64())}))
    f = _of_source(first)
    if f is None:
        blocked = blocked.join(F.broadcast(spark.createDataFrame(list(first.items()), "_s string, _u long")), "_s")
        f = F.col("_u")
    blocked = blocked.withColumn("_k", f + F.col("mix_block"))
    out = blocked.join(F.broadcast(plan) if n <= BROADCAST_BLOCKS else plan, "_k")
    return out.withColumn("mix_slot", F.col("_t")).drop("_s", "_h", "_b", "_rn", "_before", "_k", "_t", "_u")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` in mixed order: range-partitioned by slot and sorted."""
    plain, back = positional(docs, keep=("text", "source", "doc_id"))
    m = mix(plain, **how)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return back(m.repartitionByRange(n, "mix_slot", "mix_place").sortWithinPartitions("mix_slot", "mix_place"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mix(docs, period=PERIOD).select("doc_id", "source", "mix_block", "mix_place", "mix_slot")


OP9_SQL = f"""
WITH RECURSIVE src AS (SELECT CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS s, pow(count(*), {TEMPERATURE}) AS w FROM documents GROUP BY 1),
x AS (SELECT s, {PERIOD} * w / (SELECT sum(w) FROM src) AS e FROM src),
f AS (SELECT s, e, greatest(1, floor(e))::BIGINT AS base FROM x),
u AS (SELECT s, base + CASE WHEN row_number() OVER (ORDER BY e - floor(e) DESC, s) <= {PERIOD} - (SELECT sum(base) FROM f) THEN 1 ELSE 0 END AS a FROM f),
sim(t, s, a, nxt, slot_of) AS (
  SELECT 0::BIGINT, s, a, 0::BIGINT, false FROM u
  UNION ALL
  SELECT t + 1, s, a, CASE WHEN ok AND rk = 1 THEN nxt + 1 ELSE nxt END, ok AND rk = 1
  FROM (SELECT *, nxt * {PERIOD} // a <= t AS ok,
               row_number() OVER (ORDER BY nxt * {PERIOD} // a > t, ((nxt + 1) * {PERIOD} + a - 1) // a, s) AS rk
        FROM sim WHERE t < {PERIOD})
),
plan AS (SELECT s, nxt - 1 AS k, t - 1 AS slot FROM sim WHERE slot_of),
d AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS s,
             row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS rn FROM documents),
b AS (SELECT d.*, rn // {BLOCK_DOCS} AS mix_block, (rn % {BLOCK_DOCS})::INTEGER AS mix_place, a FROM d JOIN u USING (s))
SELECT doc_id, source, mix_block, mix_place, (mix_block // a) * {PERIOD} + slot AS mix_slot
FROM b JOIN plan ON plan.s = b.s AND plan.k = b.mix_block % b.a
"""
