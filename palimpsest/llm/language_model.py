"""Language-model scores: a hierarchical Pitman-Yor model sampled in Chinese restaurants.

The next word depends on the word before it. Each word is a restaurant that serves the words
that follow it, and all of these share one parent restaurant over all words, whose base is
uniform over the vocabulary and one unknown word. Words are kept by 64-bit hashes; there are
as many restaurants and dishes as the corpus has words and pairs of words.

Seating is sampled by Gibbs: the tables of each dish are drawn anew from their distribution
given all other tables of the restaurant and the parent's predictive probabilities (exactly
for up to ``EXACT`` customers, by seating them one by one above that). Dishes of a restaurant
are drawn in rounds of doubling size, and its number of tables is brought up to date between
rounds. Then every table sends a customer to the parent, and the parent's dishes are reseated.
Predictive probabilities of several sweeps are averaged.

Chunks of documents send their distinct pairs, by the hash range of the first word, to the
tasks that hold those restaurants; a sweep is one task for each range and one for each range
of the parent's words. The driver gets a few sums for each range. Answers come back to the
chunks in the order asked. No table of the model is broadcast.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_TABLE, Scratch, free_shuffles, group_arrow, held_out, map_arrow, parts, text_slices, word_hashes

CHUNK_BYTES = 8 << 20
BURN_IN, SAMPLES, SEED, EXACT = 1, 2, 17, 32
PARENT = (0.5, 1.0)  # discount and strength of the parent restaurant
DISCOUNTS, STRENGTHS = (0.3, 0.6, 0.9), (1.0, 30.0, 1e3, 3e4)  # tried for the other restaurants
END = np.uint64(0x656E640A656E640A)


def _tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every word and, after the words of each document, its end."""
    h, doc, _, _ = word_hashes(LOWER_TABLE[data], offs)
    k = len(offs) - 1
    tok = np.full(len(h) + k, END, np.uint64)
    tok[np.arange(len(h)) + doc] = h
    lens = np.bincount(doc, minlength=k) + 1
    return tok, np.repeat(np.arange(k), lens)


def _dump(*arrays) -> bytes:
    raw = pickle.dumps(arrays, protocol=5)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def _load(b) -> tuple:
    return pickle.loads(pa.Codec("zstd").decompress(b[8:], decompressed_size=int.from_bytes(b[:8], "little"), asbytes=True))


def _planes(x: np.ndarray) -> np.ndarray:
    """32-bit numbers byte by byte: small numbers are compressed better so."""
    return np.ascontiguousarray(x.astype(np.int32).view(np.uint8).reshape(-1, 4).T)


def _numbers(planes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(planes.T).view(np.int32).ravel()


def _rows(*rows: tuple) -> pa.Table:
    """Rows (kind, chunk, part, cell)."""
    kind, chunk, part, cell = zip(*rows) if rows else ((), (), (), ())
    return pa.table({"kind": pa.array(kind, pa.int32()), "chunk": pa.array(chunk, pa.int64()), "part": pa.array(part, pa.int32()), "cell": pa.array(cell, pa.binary())})


_SCHEMA = "kind int, chunk long, part int, cell binary"


def _range(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _cuts(h: np.ndarray, buckets: int):
    """(range, slice) of the ranges that sorted hashes lie in."""
    at = np.searchsorted(_range(h, buckets), np.arange(buckets + 1))
    return [(p, slice(int(at[p]), int(at[p + 1]))) for p in range(buckets) if at[p] < at[p + 1]]


def _pairs(doc: np.ndarray, inv: np.ndarray, words: np.ndarray):
    """(pair of each token, first word and second word of the distinct pairs): in order of the hashes; words sorted, END among them."""
    before = np.empty_like(inv)
    before[1:] = inv[:-1]
    before[np.flatnonzero(np.diff(doc, prepend=-1))] = np.searchsorted(words, END)
    keys, pair = np.unique(before.astype(np.int64) * len(words) + inv, return_inverse=True)
    return pair, keys // len(words), keys % len(words)


def _chunks(docs: DataFrame) -> DataFrame:
    """A row for each chunk: ids, and its words, tokens, documents and what to learn from."""

    def run(batches):
        task, seq = TaskContext.get().partitionId(), 0
        for b in batches:
            learn = np.asarray(b.column(1)).astype(bool)
            for first, data, offs in text_slices(b, limit=CHUNK_BYTES):
                tok, doc = _tokens(data, offs)
                words, inv = np.unique(tok, return_inverse=True)
                ids = pa.RecordBatch.from_arrays([b.column(0).slice(first, len(offs) - 1)], names=["doc_id"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, ids.schema) as w:
                    w.write_batch(ids)
                lens = np.bincount(doc, minlength=len(offs) - 1).astype(np.int32)
                yield from _rows((0, (task << 32) | seq, 0, _dump(sink.getvalue().to_pybytes(), words, _planes(inv), lens, learn[first : first + len(lens)]))).to_batches()
                seq += 1

    return map_arrow(docs, run, _SCHEMA)


def _ask(buckets: int):
    """Of each chunk, a row for each range: its words in the range, training counts, the pairs that begin with each, second words and training counts of these."""

    def run(batches):
        for b in batches:
            for chunk, cell in zip(b.column(1).to_pylist(), b.column(3).to_pylist()):
                _, words, inv, lens, learn = _load(cell)
                inv = _numbers(inv)
                doc = np.repeat(np.arange(len(lens)), lens)
                train = learn[doc]
                count = np.bincount(inv[train], minlength=len(words))
                pair, u, w = _pairs(doc, inv, words)
                of_pair = np.minimum(np.bincount(pair[train], minlength=len(u)), 2**31 - 1)
                at = np.searchsorted(u, np.arange(len(words) + 1))  # every word has another or an end after it
                out = []
                for p, c in _cuts(words, buckets):
                    own = slice(at[c.start], at[c.stop])
                    second, place = np.unique(w[own], return_inverse=True)
                    out.append((1, chunk, p, _dump(words[c], count[c], np.diff(at[c.start : c.stop + 1]), words[second], _planes(place), _planes(of_pair[own]))))
                yield from _rows(*out).to_batches()

    return run


def _gather(t: pa.Table, buckets: int) -> pa.Table:
    """Of one range of first words: counts of words for each chunk (kind 1) and sums (kind 4); the restaurants (kind 2), each chunk's pairs in them (kind 3), their dishes by the parent's ranges (kind 5) and the first customers of the parent (kind 11)."""
    part = t.column("part")[0].as_py()
    own = [(chunk, _load(x)) for chunk, x in zip(t.column("chunk").to_pylist(), t.column("cell").to_pylist())]
    words, inv = np.unique(np.concatenate([x[0] for _, x in own]), return_inverse=True)
    total = np.bincount(inv, weights=np.concatenate([x[1] for _, x in own])).astype(np.int64)
    out: list[tuple] = [(1, chunk, part, _dump(total[i])) for (chunk, _), i in zip(own, np.split(inv, np.cumsum([len(x[0]) for _, x in own])[:-1]))]
    out.append((4, -1, part, _dump(int(total.sum()), int((total > 0).sum()))))
    u = np.concatenate([np.repeat(x[0], x[2]) for _, x in own])
    w = np.concatenate([x[3][_numbers(x[4])] for _, x in own])
    order = np.lexsort((w, u))
    u, w = u[order], w[order]
    new = np.ones(len(u), bool)
    new[1:] = (u[1:] != u[:-1]) | (w[1:] != w[:-1])
    place = np.empty(len(u), np.int64)
    place[order] = np.cumsum(new) - 1
    c = np.bincount(place, weights=np.concatenate([_numbers(x[5]) for _, x in own])).astype(np.int64)
    words, dish = np.unique(w[new], return_inverse=True)
    rest = np.cumsum(np.append(True, u[new][1:] != u[new][:-1])) - 1
    cuts = _cuts(words, buckets)
    out.append((2, -1, part, _dump(_planes(np.bincount(rest)), _planes(dish), c, [(p, x.stop - x.start) for p, x in cuts])))
    out += [(5, part, p, _dump(words[x])) for p, x in cuts]
    out += _to_parent(part, [(p, x.stop - x.start) for p, x in cuts], dish, np.minimum(c, 1))
    for (chunk, _), i in zip(own, np.split(place, np.cumsum([x[4].shape[1] for _, x in own])[:-1])):
        out.append((3, chunk, part, _dump(np.diff(i, prepend=0).astype(np.int32))))
    return _rows(*out)


# ---------------------------------------------------------------- seating


def stirling(n: int, d: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: [customers, tables], each up to n."""
    out = np.full((n + 1, n + 1), -np.inf)
    out[0, 0] = 0.0
    with np.errstate(divide="ignore"):
        for c in range(n):
            t = np.arange(1, n + 1)
            out[c + 1, 1:] = np.logaddexp(out[c, :-1], out[c, 1:] + np.log(np.maximum(c - d * t, 0)))
    return out


def seat(count: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish after seating its customers one by one; ``weight``: of opening a new table.

    With n customers at t tables the next one opens a table with weight w against n - d*t. The
    customers until that happens are drawn at once: geometric with a Beta(w, n - d*t) rate.
    """
    tables = np.minimum(count, 1)
    n = tables.astype(float)
    live = np.flatnonzero(count > 1)
    while len(live):
        p = rng.beta(weight[live], n[live] - discount * tables[live])
        p = np.clip(p, 1e-300, 1 - 1e-16)
        n[live] += np.floor(np.log(rng.random(len(live))) / np.log1p(-p)) + 1
        live = live[n[live] <= count[live]]
        tables[live] += 1
    return tables


def redraw(count: np.ndarray, others: np.ndarray, p0: np.ndarray, discount: float, strength: float, table: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish given the tables of all other dishes of its restaurant.

    With T other tables, t tables of c customers have weight S(c, t) * p0**t * prod of
    (s + d*(T + j)) for j < t, S being a generalised Stirling number.
    """
    out = np.minimum(count, 1)
    for c in range(2, EXACT + 1):
        at = np.flatnonzero(count == c)
        for own in np.array_split(at, len(at) * c // 2_000_000 + 1):
            t = np.arange(c)
            w = np.cumsum(np.log(strength + discount * (others[own][:, None] + t)) + np.log(p0[own])[:, None], axis=1) + table[c, 1 : c + 1]
            out[own] = np.argmax(w + rng.gumbel(size=w.shape), axis=1) + 1
    many = np.flatnonzero(count > EXACT)
    out[many] = seat(count[many], (strength + discount * others[many]) * p0[many], discount, rng)
    return out


def sweep(rest: np.ndarray, count: np.ndarray, tables: np.ndarray, p0: np.ndarray, discount: float, strength: float, rng: np.random.Generator) -> np.ndarray:
    """One Gibbs sweep over dishes of restaurants (``rest``, sorted): their new numbers of tables."""
    tables = tables.copy()
    total = np.bincount(rest, weights=tables).astype(np.int64)
    many = np.flatnonzero(count > 1)
    many = many[np.lexsort((rng.random(len(many)), rest[many]))]
    place = np.arange(len(many)) - np.searchsorted(rest[many], rest[many])
    level = np.log2(place + 1).astype(np.int64)
    table = stirling(EXACT, discount)
    for k in range(int(level.max(initial=-1)) + 1):
        own = many[level == k]
        now = redraw(count[own], total[rest[own]] - tables[own], p0[own], discount, strength, table, rng)
        total += np.bincount(rest[own], weights=now - tables[own], minlength=len(total)).astype(np.int64)
        tables[own] = now
    return tables


def predictive(rest: np.ndarray, count: np.ndarray, tables: np.ndarray, p0: np.ndarray, discount: float, strength: float) -> np.ndarray:
    """Probability of each dish of each restaurant; dishes without customers are those asked for only."""
    total, opened = (np.bincount(rest, weights=x)[rest] for x in (count, tables))
    return (np.maximum(count - discount * tables, 0) + (strength + discount * opened) * p0) / (strength + total)


def _gains(rest: np.ndarray, count: np.ndarray, p0: np.ndarray) -> np.ndarray:
    """For each discount and strength tried, the log probability of all customers, each left out in turn; one table a dish."""
    total, opened = (np.bincount(rest, weights=x)[rest] for x in (count, count > 0))
    live = count > 0
    c, n, t, p = count[live], total[live], opened[live], p0[live]
    t = t - (c == 1)
    return np.array([[(c * np.log((np.maximum(c - 1 - d, 0) + (s + d * t) * p) / (s + n - 1))).sum() for s in STRENGTHS] for d in DISCOUNTS])


# ---------------------------------------------------------------- sweeps over ranges


def _to_parent(part: int, cuts: list[tuple[int, int]], dish: np.ndarray, tables: np.ndarray) -> list[tuple]:
    """Rows of kind 11, range by range: the customers that a task's tables send to the parent. ``chunk`` is the range of the sender."""
    up = np.bincount(dish, weights=tables, minlength=sum(n for _, n in cuts)).astype(np.int64)
    at = np.cumsum([0, *[n for _, n in cuts]])
    return [(11, part, p, _dump(up[a:b])) for (p, _), a, b in zip(cuts, at, at[1:])]


def _parent(vocabulary: int, opened: int, seed: int):
    """Of one range of the parent's words: for each sender the customers less discounts (kind 6), and sums (kind 7). ``opened``: tables of the parent so far."""

    def run(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        cells = {(k, s): _load(x)[0] for k, s, x in zip(t.column("kind").to_pylist(), t.column("chunk").to_pylist(), t.column("cell").to_pylist())}
        own = [(sender, cells[5, sender], cells[11, sender]) for k, sender in sorted(cells) if k == 5]
        words, inv = np.unique(np.concatenate([x for _, x, _ in own]), return_inverse=True)
        up = np.bincount(inv, weights=np.concatenate([x for _, _, x in own])).astype(np.int64)
        d0, s0 = PARENT
        rng = np.random.default_rng([seed, part])
        top = redraw(up, np.maximum(opened - np.minimum(up, 1), 0), np.full(len(up), 1 / (vocabulary + 1)), d0, s0, stirling(EXACT, d0), rng)
        kept = (up - d0 * top).astype(np.float64)
        out = [(6, sender, part, _dump(kept[i])) for (sender, *_), i in zip(own, np.split(inv, np.cumsum([len(x) for _, x, _ in own])[:-1]))]
        return _rows(*out, (7, -1, part, _dump(int(up.sum()), int(top.sum()))))

    return run


def score(docs: DataFrame, learn: str = "learn") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs``.

    ``docs``: doc_id, text and a boolean column of the rows to learn from (null: false). A
    null or empty text has one token, its end. Rows that repeat a doc_id are scored each. With
    nothing to learn from, every probability of a word is that of one unknown word. A very
    long text is a chunk of its own. Other columns are not read, whatever their names. All
    words unknown to the training share the probability of one unknown word.

    The pairs that begin with one word lie in one task: they are at most as many as there are
    words.
    """
    spark = docs.sparkSession
    tmp = Scratch(spark, "languagemodel")
    buckets = parts(spark, docs)
    own = docs.select("doc_id", F.coalesce(F.col(learn), F.lit(False)).alias("learn"), "text")

    def put(df: DataFrame, name: str) -> DataFrame:
        written = tmp.write(df, name, "kind")
        out = written.select("kind", "chunk", "part", "cell")
        out._scratch_path = written._scratch_path
        return out

    chunks = put(_chunks(own), "chunks")
    state = put(group_arrow(map_arrow(chunks, _ask(buckets), _SCHEMA).groupBy("part"), lambda t: _gather(t, buckets), _SCHEMA), "state")
    free_shuffles(spark)
    sums = [_load(bytes(r.cell)) for r in state.filter("kind = 4").select("cell").collect()]
    n, v = (sum(x[i] for x in sums) for i in (0, 1))
    d0, s0 = PARENT

    rooms, menu = state.filter("kind = 2"), state.filter("kind = 5")
    sent, opened, how = state, v, None
    for k in range(BURN_IN + SAMPLES):
        parent = put(group_arrow(menu.unionByName(sent.filter("kind = 11")).groupBy("part"), _parent(v, opened, SEED + k), _SCHEMA), f"parent{k}")
        if k + 1 == BURN_IN + SAMPLES:
            for x in (5, 11):
                tmp.remove(f"{state._scratch_path.rsplit('/', 1)[1]}/kind={x}")
        free_shuffles(spark)
        tops = [_load(bytes(r.cell)) for r in parent.filter("kind = 7").select("cell").collect()]
        customers, opened = (sum(x[i] for x in tops) for i in (0, 1))
        base, below = (s0 + d0 * opened) / (v + 1), s0 + customers

        def read(left: pa.Table, right: pa.Table, base=base, below=below):
            """(part, restaurants, dishes, counts, cuts of the dishes, tables, sums of predictions, p0 of each pair)."""
            cells = dict(zip(left.column("kind").to_pylist(), left.column("cell").to_pylist()))
            rest, dish, c, cuts = _load(cells[2])
            rest, dish = _numbers(rest), _numbers(dish)
            rest = np.repeat(np.arange(len(rest)), rest)
            tables, acc = _load(cells[8]) if 8 in cells else (np.minimum(c, 1), None)
            order = np.argsort(np.asarray(right.column("part")))
            got = right.column("cell").to_pylist()
            kept = np.concatenate([_load(got[i])[0] for i in order])
            return left.column("part")[0].as_py(), rest, dish, c, cuts, tables, acc, ((kept + base) / below)[dish]

        # rows of kind 6 go back to their sender
        back = parent.filter("kind = 6").select("kind", F.col("chunk").cast("int").alias("sender"), "part", "cell")
        if how is None:

            def gains(left: pa.Table, right: pa.Table) -> pa.Table:
                if not left.num_rows:
                    return _rows()
                part, rest, _, c, _, _, _, p0 = read(left, right)
                return _rows((9, -1, part, _dump(_gains(rest, c, p0))))

            got = group_arrow(rooms.groupBy("part").cogroup(back.groupBy("sender")), gains, _SCHEMA).select("cell").collect()
            total = sum((_load(bytes(r.cell))[0] for r in got), np.zeros((len(DISCOUNTS), len(STRENGTHS))))
            i, j = np.unravel_index(total.argmax(), total.shape)
            how = (DISCOUNTS[i], STRENGTHS[j])

        def step(left: pa.Table, right: pa.Table, k=k, how=how) -> pa.Table:
            if not left.num_rows:
                return _rows()
            part, rest, dish, c, cuts, tables, acc, p0 = read(left, right)
            tables = sweep(rest, c, tables, p0, *how, np.random.default_rng([SEED, k, part]))
            if k >= BURN_IN:
                p = predictive(rest, c, tables, p0, *how)
                acc = (p if acc is None else acc + p).astype(np.float32)
            more = _to_parent(part, cuts, dish, tables) if k + 1 < BURN_IN + SAMPLES else []
            return _rows((8, -1, part, _dump(tables.astype(np.int32), acc)), *more)

        now = rooms if k == 0 else rooms.unionByName(sent.filter("kind = 8"))
        before, sent = sent, put(group_arrow(now.groupBy("part").cogroup(back.groupBy("sender")), step, _SCHEMA), f"sweep{k}")
        if k:
            tmp.drop(before)
        tmp.drop(parent)
        free_shuffles(spark)

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        """The log probabilities of each chunk's pairs of one range."""
        if not left.num_rows:
            return _rows()
        p = np.log10(_load(left.column("cell")[0].as_py())[1] / SAMPLES).astype(np.float32)
        part = left.column("part")[0].as_py()
        return _rows(*[(10, chunk, part, _dump(p[np.cumsum(_load(cell)[0])])) for chunk, cell in zip(right.column("chunk").to_pylist(), right.column("cell").to_pylist())])

    final = sent.filter("kind = 8")
    answers = put(group_arrow(final.groupBy("part").cogroup(state.filter("kind = 3").groupBy("part")), answer, _SCHEMA), "answers")
    tmp.drop(sent)
    for k in (2, 3):  # only the counts of words are needed further
        tmp.remove(f"{state._scratch_path.rsplit('/', 1)[1]}/kind={k}")
    free_shuffles(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, words, inv, lens, _ = _load(left.column("cell")[0].as_py())
        inv = _numbers(inv)
        ids = pa.ipc.open_stream(ids).read_all().column("doc_id")
        doc = np.repeat(np.arange(len(lens)), lens)
        rows = sorted(zip(right.column("kind").to_pylist(), right.column("part").to_pylist(), right.column("cell").to_pylist()))
        c, log = (np.concatenate([_load(x)[0] for a, _, x in rows if a == want]) for want in (1, 10))
        base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
        pair, _, _ = _pairs(doc, inv, words)
        k = len(ids)
        return pa.table({
            "doc_id": ids.combine_chunks(),
            "n_tokens": pa.array(lens.astype(np.int64)),
            "n_known": pa.array(np.bincount(doc[(c > 0)[inv]], minlength=k)),
            "train_tokens": pa.array(np.full(k, n)),
            "base_score": pa.array(np.bincount(doc, weights=base[inv], minlength=k)),
            "score": pa.array(np.bincount(doc, weights=log.astype(np.float64)[pair], minlength=k)),
        })

    back = state.filter("kind = 1").unionByName(answers)
    return group_arrow(chunks.groupBy("chunk").cogroup(back.groupBy("chunk")), run, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def perplexity(scored: DataFrame) -> DataFrame:
    """Perplexity per token of the model and of the base over all rows of :func:`score`."""
    per = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.agg(per("score").alias("perplexity"), per("base_score").alias("base_perplexity"), F.sum("n_tokens").alias("n_tokens"))


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = held_out(F.col("doc_id"), 1)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", (~out).alias("learn"))
    return score(docs).select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
