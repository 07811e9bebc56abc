"""Token ids packed into fixed-length rows: best-fit-decreasing with a segment tree over capacities.

Each task tokenises its texts, splits documents longer than a row into full rows and a
rest, and packs the pieces of every few million tokens. No shuffle; memory is bounded by
the tokens packed at once plus the longest document. Each task ends with one set of rows
that its last pieces fill as far as they go, so tasks of far fewer than ``pack_tokens``
tokens fill rows less well (0.999 of the ids are tokens with 4 million, 0.945 with 25,000).
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import map_arrow

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50256  # free id of that vocabulary: ends every document and fills rows
ROW, PACK_TOKENS = 2048, 4_000_000

#: Fixed value: the pre-token pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

SCHEMA = "row_id long, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<{id}>, doc_offsets array<long>"

#: White space (Unicode's) in a row that the pattern's look-ahead must not walk through: it would take a stack frame for each.
BLANKS = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{10000,}")


class Tokens:
    """Text -> ids. Each text is encoded in one call: keeping the encodings of words costs more than the encoder does."""

    def __init__(self, vocabulary: str):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.enc = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text. A long run of white space is one token of the pattern, but for its last character where a word follows."""
        out, last = [], 0
        for run in BLANKS.finditer(text):
            end = run.end() - (run.end() < len(text))
            out += self.enc.encode_ordinary(text[last : run.start()])
            out += self.enc._core_bpe.encode_single_piece(text[run.start() : end].encode())
            last = end
        out += self.enc.encode_ordinary(text[last:] if last else text)
        return np.asarray(out, np.uint32).tobytes()

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.whole(text), np.uint32)


class Capacities:
    """Segment tree over capacities 0..row: finds the least capacity that still fits."""

    def __init__(self, row: int):
        self.n = 1 << (row + 1).bit_length()
        self.open: list[list[int]] = [[] for _ in range(row + 1)]
        self.tree = [False] * (2 * self.n)

    def put(self, capacity: int, row: int) -> None:
        self.open[capacity].append(row)
        i = capacity + self.n
        while i and not self.tree[i]:
            self.tree[i] = True
            i >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(capacity, row) of the fullest row that has ``size`` left."""
        i = size + self.n
        if not self.tree[i]:
            while i > 1 and (i & 1 or not self.tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.n:
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        capacity = i - self.n
        row = self.open[capacity].pop()
        if not self.open[capacity]:
            while i:
                self.tree[i] = i < self.n and (self.tree[2 * i] or self.tree[2 * i + 1])
                if self.tree[i]:
                    break
                i >>= 1
        return capacity, row


def best_fit_decreasing(sizes: list[int], row: int) -> list[list[int]]:
    """Piece numbers of each row; pieces (1..row long) go largest first into the fullest row that fits."""
    rows: list[list[int]] = []
    free = Capacities(row)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        got = free.take(sizes[i])
        if got is None:
            capacity, r = row, len(rows)
            rows.append([])
        else:
            capacity, r = got
        rows[r].append(i)
        if capacity > sizes[i]:
            free.put(capacity - sizes[i], r)
    return rows


def _flush(pieces: list[tuple], row: int, first: int, dtype, kind: pa.DataType, ordered: bool = False) -> pa.RecordBatch:
    """pieces: (doc_id, offset in the document, ids). ``ordered``: rows by the place of their middle token."""
    rows = best_fit_decreasing([len(p[2]) for p in pieces], row)
    if ordered:
        rows = sorted((sorted(r) for r in rows), key=lambda r: (sum(i * len(pieces[i][2]) for i in r) / sum(len(pieces[i][2]) for i in r), r[0]))
    ids, n, cu, resets, docs, offs = [], [], [], [], [], []
    for members in rows:
        m = np.full(row, END, dtype)
        ends = np.cumsum([len(pieces[i][2]) for i in members])
        start = 0
        for i, e in zip(members, ends.tolist()):
            m[start:e] = pieces[i][2]
            start = e
        ids.append(m.tobytes())
        n.append(start)
        cu.append([0, *ends.tolist()])
        resets.append([0, *ends.tolist()[:-1]])
        docs.append([pieces[i][0] for i in members])
        offs.append([pieces[i][1] for i in members])
    return pa.RecordBatch.from_arrays(
        [pa.array(range(first, first + len(rows)), pa.int64()), pa.array(n, pa.int32()), pa.array(ids, pa.binary()), pa.array(cu, pa.list_(pa.int32())), pa.array(resets, pa.list_(pa.int32())), pa.array(docs, pa.list_(kind)), pa.array(offs, pa.list_(pa.int64()))],
        names=["row_id", "n_tokens", "ids", "cu_seqlens", "position_resets", "doc_ids", "doc_offsets"],
    )


def pack(docs: DataFrame, row: int = ROW, vocabulary: str = VOCABULARY, pack_tokens: int = PACK_TOKENS, ordered: bool = False) -> DataFrame:
    """Packed rows of token ids (16-bit little-endian, filled with the end id).

    For each row: n_tokens used; cu_seqlens, the cumulative lengths of its segments;
    position_resets, where position ids start again at 0; for each segment its doc_id and its
    offset in the document's tokens. Every document, a null or empty one too, ends with the
    end id, so each has a segment. Documents longer than a row are split, losslessly, into
    full rows and a rest. doc_id may be of any type, null too; rows that repeat a doc_id get a
    segment each. Only doc_id and text are read, whatever other columns are called.

    ``ordered``: row_id follows the order of ``docs`` but for the rows packed at once, which go
    by the mean place of their tokens.
    """
    own = docs.select("doc_id", "text")

    def run(batches):
        tok, first = Tokens(vocabulary), TaskContext.get().partitionId() << 32
        pieces: list[tuple] = []
        held = 0
        kind = pa.int64()
        for b in batches:
            kind = b.column(0).type
            for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.append(tok.encode(t.as_py() or ""), END).astype(np.uint16)
                pieces += [(d, o, ids[o : o + row]) for o in range(0, len(ids), row)]
                held += len(ids)
                if held >= pack_tokens:
                    out = _flush(pieces, row, first, np.uint16, kind, ordered)
                    yield from _bounded(out)
                    first, pieces, held = first + out.num_rows, [], 0
        if pieces:
            yield from _bounded(_flush(pieces, row, first, np.uint16, kind, ordered))

    return map_arrow(own, run, SCHEMA.format(id=own.schema["doc_id"].dataType.simpleString()))


def _bounded(batch: pa.RecordBatch, rows: int = 1024):
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def unpack(rows) -> dict:
    """doc_id -> ids of the whole document (end id included), from collected packed rows; for tests and readers."""
    got: dict = {}
    for r in rows:
        ids = np.frombuffer(bytes(r["ids"]), np.uint16)
        for d, o, a, b in zip(r["doc_ids"], r["doc_offsets"], r["cu_seqlens"], r["cu_seqlens"][1:]):
            got.setdefault(d, []).append((o, ids[a:b]))
    return {d: np.concatenate([x for _, x in sorted(p, key=lambda y: y[0])]) for d, p in got.items()}


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
