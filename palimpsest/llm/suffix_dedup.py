"""Removal of byte strings that repeat anywhere in the corpus, by a distributed difference cover.

The cover is a perfect difference set modulo a period v: ten residues of 91, so that of any
two positions some equal shift below 91 leads to two samples. Positions count from the start
of their document.

1. The v bytes at every sample are named: the names are sorted over all documents, and a name
   that occurs once ends the matter for its sample.
2. The recursion works on the string of names: triples of adjacent names (of p, p+v and p+2v),
   that is 3v bytes, are sorted and named again. A 400-byte string that occurs twice holds, at
   one shift in both places, a sample whose triple occurs twice. A sample also shows the
   string of all 400-byte windows that it lies in the first v bytes of; if that occurs again,
   so do all these windows.
3. The remaining windows are merged: a window that lies in open samples is keyed by 96 bits of
   its whole 400 bytes, the keys are sorted, and neighbours with equal keys are the same string.

Only names are compared, never bytes: names have 64 bits, those of windows 96, so that a
window goes wrongly with a chance of about (windows)**2 / 2**97. No suffix is ranked beyond
400 bytes, since that is all the result depends on.

Texts stay where they are, in a table bucketed by chunk. What is shuffled is names,
deduplicated in each chunk, and the answers to them in the same order.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import Scratch, free_shuffles, group_arrow, map_arrow, mix, parts, prefix_hash, range_hash, text_slices

LENGTH, PERIOD = 400, 91
#: Perfect difference sets by period: every difference but 0 occurs once. Fixed values.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52), 91: (0, 1, 3, 9, 27, 49, 56, 61, 77, 81)}
CHUNK_BYTES = 4 << 20
DEAD, COVERED, OPEN, WITNESS = 0, 1, 2, 3  # answers for a triple; a witness is covered and shows its windows to open ones
NAMES, TRIPLES, WINDOWS = 0, 1, 2  # questions
_SECOND = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))  # values of bytes for a second hash


def samples(data: np.ndarray, offs: np.ndarray, length: int, period: int):
    """(prefix hash, name of each sample, samples that start a triple, position, first and last window of these).

    Windows are the starts p with p + length within the document; those that a sample lies in
    the first ``period`` bytes of are adjacent.
    """
    cover = np.array(COVERS[period])
    h = prefix_hash(data)
    lens = np.diff(offs)
    long = np.flatnonzero(lens >= length)
    n = lens[long] - length + 3 * period  # positions of samples whose names are needed
    each = -(-n // period) * len(cover)
    doc = np.repeat(np.arange(len(long)), each)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
    at = (k // len(cover)) * period + cover[k % len(cover)]
    ok = at < n[doc]
    doc, at = doc[ok], at[ok]
    start = offs[long][doc]
    p = start + at
    # the sample one period on is len(cover) places on; triples start where two more periods are sampled
    first = np.flatnonzero(at < n[doc] - 2 * period)
    a, lo = p[first], start[first]
    return h, range_hash(h, p, p + period), first, a, np.maximum(a - period + 1, lo), np.minimum(a, lo + lens[long][doc[first]] - length)


def _triples(h, name, first, a, lo, hi, length, width):
    """(name of the triple, name of the string of all its windows)."""
    x = name[first]
    for i in (1, 2):
        x = mix(x * np.uint64(0x9DDFEA08EB382D69) + name[first + i * width])
    return x, mix(range_hash(h, lo, hi + length) + (a - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _distinct(*keys: np.ndarray):
    """(distinct rows of the keys, sorted; row of each element; count of each row)."""
    order = np.lexsort(keys[::-1])
    s = [k[order] for k in keys]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in s:
        new[1:] |= k[1:] != k[:-1]
    row = np.empty(len(order), np.int64)
    row[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return [k[new] for k in s], row, np.diff(np.append(first, len(order)))


def _slice(table_row_ids: bytes, data: np.ndarray, lens: np.ndarray):
    """The slice a chunk holds: ids, data, offsets."""
    ids = pa.ipc.open_stream(table_row_ids).read_all().column("doc_id").combine_chunks()
    return ids, data, np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)


def _ask(chunk: int, keys: list[np.ndarray], widths: list[int], count: np.ndarray, buckets: int):
    """Rows (chunk, part, keys, counts): one for each range of the first key; of each key its ``width`` highest bytes."""
    part = ((keys[0] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    at = np.searchsorted(part, np.arange(buckets + 1))
    live = np.flatnonzero(at[1:] > at[:-1])
    if not len(live):
        return
    cut = [slice(at[p], at[p + 1]) for p in live]
    raw = [np.ascontiguousarray(k).view(np.uint8).reshape(-1, 8)[:, 8 - w :] for k, w in zip(keys, widths)]
    yield pa.RecordBatch.from_arrays(
        [pa.array([chunk] * len(live), pa.int64()), pa.array(live.astype(np.int32)), pa.array([b"".join(k[c].tobytes() for k in raw) for c in cut], pa.binary()), pa.array([np.minimum(count[c], 2).astype(np.uint8).tobytes() for c in cut], pa.binary())],
        names=["chunk", "part", "keys", "counts"],
    )


def _asked(t: pa.Table, widths: list[int]):
    """(the keys of all rows, their counts, where each row ends)."""
    counts = [np.frombuffer(x.as_py(), np.uint8) for x in t.column("counts")]
    keys = [np.zeros((sum(map(len, counts)), 8), np.uint8) for _ in widths]
    at = 0
    for x, c in zip(t.column("keys"), counts):
        raw, skip = np.frombuffer(x.as_py(), np.uint8), 0
        for k, w in zip(keys, widths):
            k[at : at + len(c), 8 - w :] = raw[skip : skip + w * len(c)].reshape(-1, w)
            skip += w * len(c)
        at += len(c)
    return [k.view(np.uint64).ravel() for k in keys], np.concatenate(counts).astype(np.int64), np.cumsum([len(c) for c in counts])


def _cut(keys: list[np.ndarray], widths: list[int]) -> list[np.ndarray]:
    """The keys with all but their ``width`` highest bytes cleared."""
    return [k & ~np.uint64((1 << 8 * (8 - w)) - 1) for k, w in zip(keys, widths)]


# bytes sent of each key: a name decides only whether its sample goes on, so 48 bits do
W_NAMES, W_TRIPLES, W_WINDOWS = [6], [8, 8], [8, 4]
_ASKED = "chunk long, part int, keys binary, counts binary"
_ASKED_ARROW = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_ANSWER = "chunk long, ask int, part int, answers binary"


def _answered(t: pa.Table, ask: int, answers: np.ndarray, ends: np.ndarray) -> pa.Table:
    cut = np.split(answers.astype(np.uint8), ends[:-1])
    n = t.num_rows
    return pa.table({"chunk": t.column("chunk"), "ask": pa.array([ask] * n, pa.int32()), "part": t.column("part"), "answers": pa.array([x.tobytes() for x in cut], pa.binary())})


def _judge(question: int, widths: list[int]):
    """Answers to names and windows: whether each occurs twice."""

    def run(t: pa.Table) -> pa.Table:
        keys, count, ends = _asked(t, widths)
        _, row, _ = _distinct(*keys)
        return _answered(t, question, np.bincount(row, weights=count)[row] >= 2, ends)

    return run


def _judge_triples(t: pa.Table) -> pa.Table:
    (triple, whole), count, ends = _asked(t, W_TRIPLES)
    (s, _), row, _ = _distinct(triple, whole)
    times = np.bincount(row, weights=count).astype(np.int64)  # of each string of windows
    _, name, _ = _distinct(s)
    occurs = np.bincount(name, weights=times)[name]
    opens = np.bincount(name, weights=times == 1)[name] > 0
    answer = np.where(occurs < 2, DEAD, np.where(times < 2, OPEN, COVERED))[row]
    first = np.zeros(len(row), bool)
    first[np.unique(row, return_index=True)[1]] = True
    answer[first & (answer == COVERED) & opens[row]] = WITNESS
    return _answered(t, TRIPLES, answer, ends)


def _got(t: pa.Table, ask: int) -> np.ndarray:
    """The answers to one question of a chunk, in the order asked."""
    rows = sorted((p, x) for a, p, x in zip(t.column("ask").to_pylist(), t.column("part").to_pylist(), t.column("answers").to_pylist()) if a == ask)
    return np.frombuffer(b"".join(x for _, x in rows), np.uint8)


def _marked(n: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Whether each of n + 1 positions lies in one of the runs [lo, hi]."""
    edge = np.bincount(lo, minlength=n + 2) - np.bincount(hi + 1, minlength=n + 2)
    return np.cumsum(edge)[: n + 1] > 0


def repeats(docs: DataFrame, length: int = LENGTH, period: int = PERIOD, with_kept: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte ranges [from, to)) and, if asked, kept (bytes).

    A byte goes when a string of ``length`` bytes over it also starts at another place of the
    input, overlaps and the same document included. Null counts as empty; texts shorter than
    ``length`` lose nothing. Every input row gives one row, repeated ids too. A very long text
    is a chunk of its own. Only doc_id and text are read, whatever other columns are called.
    ``period``: of the difference cover, one of COVERS. The result is a written table.
    """
    if length < 4 * period - 1:
        raise ValueError("length must be four periods less one at least")
    width = len(COVERS[period])
    spark = docs.sparkSession
    tmp = Scratch(spark, "repeats")
    buckets = parts(spark, docs)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def chunks(batches):
        task, seq = TaskContext.get().partitionId(), 0
        for b in batches:
            for first, data, offs in text_slices(b, limit=CHUNK_BYTES):
                own = pa.RecordBatch.from_arrays([b.column(0).slice(first, len(offs) - 1)], names=["doc_id"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, own.schema) as w:
                    w.write_batch(own)
                yield pa.RecordBatch.from_arrays([pa.array([(task << 32) | seq], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([np.diff(offs).astype(np.int64).tobytes()], pa.binary()), pa.array([data.tobytes()], pa.binary())], names=["chunk", "ids", "lens", "data"])
                seq += 1

    name = f"palimpsest_chunks_{uuid.uuid4().hex}"
    rows = map_arrow(docs.select("doc_id", "text"), chunks, "chunk long, ids binary, lens binary, data binary")
    # bucketed by chunk: the questions' answers are brought to the texts, never the texts to the answers
    rows.write.bucketBy(buckets, "chunk").option("compression", "zstd").option("path", f"{tmp.root}/chunks").saveAsTable(name)
    texts = spark.table(name)

    def read(t: pa.Table):
        ids, data, offs = _slice(t.column("ids")[0].as_py(), np.frombuffer(t.column("data")[0].as_py(), np.uint8), np.frombuffer(t.column("lens")[0].as_py(), np.int64))
        return ids, data, offs, *samples(data, offs, length, period)

    def ask_names(batches):
        for b in batches:
            for i in range(b.num_rows):
                t = pa.Table.from_batches([b.slice(i, 1)])
                keys, _, count = _distinct(*_cut([read(t)[4]], W_NAMES))
                yield from _ask(t.column("chunk")[0].as_py(), keys, W_NAMES, count, buckets)

    def triples(left: pa.Table, right: pa.Table):
        """The triples of three repeated names, with their windows."""
        ids, data, offs, h, name, first, a, lo, hi = read(left)
        (_,), row, _ = _distinct(*_cut([name], W_NAMES))
        again = _got(right, NAMES)[row] > 0 if len(row) else np.zeros(0, bool)
        live = again[first] & again[first + width] & again[first + 2 * width] if len(first) else np.zeros(0, bool)
        first, a, lo, hi = first[live], a[live], lo[live], hi[live]
        return ids, data, offs, h, lo, hi, _distinct(*_triples(h, name, first, a, lo, hi, length, width))

    def ask_triples(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_batches([], _ASKED_ARROW)
        keys, _, count = triples(left, right)[-1]
        return pa.Table.from_batches(list(_ask(left.column("chunk")[0].as_py(), keys, W_TRIPLES, count, buckets)), _ASKED_ARROW)

    def open_windows(left: pa.Table, right: pa.Table):
        """What :func:`triples` gives, whether each byte starts a window known to repeat, and the windows shown."""
        ids, data, offs, h, lo, hi, (_, row, _) = triples(left, right)
        state = _got(right, TRIPLES)[row] if len(row) else np.zeros(0, np.uint8)
        sure, shown = (_marked(len(data), lo[x], hi[x]) for x in ((state == COVERED) | (state == WITNESS), (state == OPEN) | (state == WITNESS)))
        p = np.flatnonzero(shown)
        two = prefix_hash(data, _SECOND) if len(p) else h
        return ids, data, offs, sure, p, _cut([range_hash(h, p, p + length), range_hash(two, p, p + length)], W_WINDOWS)

    def ask_windows(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_batches([], _ASKED_ARROW)
        *_, sure, p, w = open_windows(left, right)
        keys, row, count = _distinct(*w)
        # a window known to repeat counts twice: its other places need not be shown
        count[np.unique(row[sure[p]])] = 2
        return pa.Table.from_batches(list(_ask(left.column("chunk")[0].as_py(), keys, W_WINDOWS, count, buckets)), _ASKED_ARROW)

    def judged(asked: DataFrame, judge, label: str) -> DataFrame:
        out = tmp.write(group_arrow(asked.groupBy("part"), judge, _ANSWER), label)
        free_shuffles(spark)
        return out

    by = lambda df: df.groupBy("chunk")
    answers = judged(map_arrow(texts, ask_names, _ASKED), _judge(NAMES, W_NAMES), "names")
    answers = answers.unionByName(judged(group_arrow(by(texts).cogroup(by(answers)), ask_triples, _ASKED), _judge_triples, "triples"))
    answers = answers.unionByName(judged(group_arrow(by(texts).cogroup(by(answers)), ask_windows, _ASKED), _judge(WINDOWS, W_WINDOWS), "windows"))

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, data, offs, again, p, w = open_windows(left, right)
        if len(p):
            _, row, _ = _distinct(*w)
            again[p[_got(right, WINDOWS)[row] > 0]] = True
        seen = np.concatenate([[0], np.cumsum(again[:-1])])
        gone = seen[1:] > seen[np.maximum(np.arange(1, len(data) + 1) - length, 0)]
        edge = np.zeros(len(data) + 1, bool)
        edge[offs] = True
        start = gone & np.concatenate([[True], ~gone[:-1]]) | (gone & edge[:-1]) if len(data) else gone
        end = gone & np.concatenate([~gone[1:], [True]]) | (gone & edge[1:]) if len(data) else gone
        s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
        of = np.searchsorted(s, offs)
        total = np.concatenate([[0], np.cumsum(gone)])
        raw, sha, kept, spans = data.tobytes(), [], [], []
        for i in range(len(ids)):
            b0 = int(offs[i])
            own = [(int(s[j]) - b0, int(e[j]) - b0) for j in range(of[i], of[i + 1])]
            left_over, last = [], b0
            for x, y in own:
                left_over.append(raw[last : b0 + x])
                last = b0 + y
            left_over.append(raw[last : int(offs[i + 1])])
            k = b"".join(left_over)
            sha.append(hashlib.sha256(k).hexdigest())
            kept.append(k)
            spans.append([{"from": x, "to": y} for x, y in own])
        out = {
            "doc_id": ids,
            "n_bytes": pa.array(np.diff(offs)),
            "n_removed": pa.array(total[offs[1:]] - total[offs[:-1]]),
            "n_spans": pa.array(np.diff(of)),
            "kept_sha256": pa.array(sha, pa.string()),
            "spans": pa.array(spans, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))),
        }
        if with_kept:
            out["kept"] = pa.array(kept, pa.binary())
        return pa.table(out)

    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<from:long,to:long>>" + ", kept binary" * with_kept
    out = tmp.write(group_arrow(by(texts).cogroup(by(answers)), remove, schema), "out")
    spark.sql(f"DROP TABLE {name}")
    tmp.remove("chunks")
    return out


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), with_kept=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP1_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS x, strlen(coalesce(text, '')) AS n FROM documents),
s AS (SELECT doc_id, i, sha256(x[i : i + 399]) AS h FROM d, unnest(range(1, n - 398)) AS t(i)),
r AS (SELECT doc_id, i FROM s JOIN (SELECT h FROM s GROUP BY h HAVING count(*) > 1) USING (h)),
b AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM r),
p AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS z FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM b) GROUP BY doc_id, k),
k AS (SELECT doc_id, n, x, coalesce(lag(z) OVER w, 1) AS a, p.a AS z FROM d JOIN p USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY p.a)),
e AS (SELECT doc_id, a AS pos, x[a : z - 1] AS piece FROM k UNION ALL SELECT doc_id, max(z), any_value(x)[max(z) : any_value(n)] FROM d JOIN p USING (doc_id) GROUP BY doc_id),
j AS (SELECT doc_id, sha256(unhex(string_agg(hex(piece), '' ORDER BY pos))) AS sha FROM e GROUP BY doc_id),
c AS (SELECT doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans FROM p GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(sha, sha256(x)) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN j USING (doc_id)
"""
