"""Exact dedup, language ID, mixing, packing, language model and the pipeline on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import exact_dedup, language_id, language_model, mixing, packing
from palimpsest.llm.ngram_join import link

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, "The same text, twice over", "en", "a", 1),
    (2, "the SAME text, twice over", None, "a", None),
    (2, "the SAME text, twice over", None, "a", None),
    (3, None, "fr", None, None),
    (4, "", "fr", None, None),
    (5, "É é", "fr", "b", 2),
    (6, "é é", "fr", "b", 2),
    (7, "wörter " * 4000, "de", "b", 2),
    (None, "12 34 !", "de", "c", 2),
    (None, "the same text, twice over", "en", "c", 2),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumns({"name": F.lit("clash"), "_0": F.lit(1), "lang_pred": F.lit(2), "mix_slot": F.lit("x"), "learn": F.lit(True)})


# ---------------------------------------------------------------- exact dedup


def equal_texts(docs):
    groups = defaultdict(list)
    for d, t in docs:
        groups[(t or "").translate(FOLD)].append(d)
    out = []
    for d, t in docs:
        n = (t or "").translate(FOLD)
        keep = max((x for x in groups[n] if x is not None), default=None)
        out.append((d, keep, len(groups[n]), d == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block,bits", [(4096, 64), (3, 64), (4, 2), (1, 1)])
def test_block_names(spark, odd, block, bits):
    rng = random.Random(block)
    docs = [(d, t) for d, t, *_ in ODD if d != 7] + [(100 + i, "".join(rng.choice("abA") for _ in range(rng.randrange(9)))) for i in range(150)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"name": F.lit(1), "level": F.lit(2)})
    got = exact_dedup.exact_dedup(df, block, bits)
    assert sorted(map(tuple, got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str) == equal_texts(docs)


def test_exact_dedup_edges(odd):
    assert exact_dedup.exact_dedup(odd).count() == len(ODD)
    assert exact_dedup.exact_dedup(odd.limit(0)).count() == 0


# ---------------------------------------------------------------- language ID


def test_language_held_out(spark, sf):
    got = language_id.op10_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right, n = got.filter("held_out").agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right / n > 0.97
    assert {r.doc_id for r in got.filter("held_out").collect()} == {r.doc_id for r in got.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}


def test_language_edges(odd):
    model = language_id.train(odd)
    got = language_id.identify(odd, model)
    assert got.columns == [c for c in odd.columns if c != "lang_pred"] + ["lang_pred", "lang_score"]
    rows = {(r.doc_id, r.text): (r.lang_pred, r.lang_score) for r in got.collect()}
    assert rows[(3, None)] == rows[(4, "")] == rows[(None, "12 34 !")] == ("und", 0.0)
    assert rows[(7, "wörter " * 4000)][0] == "de" and all(0 <= s <= 1 for _, s in rows.values())
    kept = language_id.accepted(odd, model)
    assert kept.columns == odd.columns and kept.filter("doc_id IN (3, 4)").count() == 0
    assert language_id.identify(odd, language_id.train(odd.limit(0))).filter("lang_pred <> 'und'").count() == 0
    assert language_id.identify(odd.limit(0), model).count() == 0


def test_language_against_plain_bayes(spark):
    """Scores of the hashed counts against dictionaries of n-grams (few enough that none share a bucket)."""
    teach = [("the cat sat", "x"), ("a cat ran", "x"), ("le chat noir", "y"), ("un chat", "y"), ("le rat", "y")]
    ask = ["the rat", "chat cat", "zzz", "le"]

    def grams(t):
        t = f" {t} "
        return Counter((n, t[i : i + n]) for n in (1, 2, 3) for i in range(len(t) - n + 1) if t[i : i + n].strip())

    count = {g: sum((grams(t) for t, own in teach if own == g), Counter()) for g in "xy"}
    df = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(teach)], "doc_id long, text string, lang string")
    got = {r.text: r for r in language_id.identify(spark.createDataFrame([(t,) for t in ask], "text string"), language_id.train(df)).collect()}
    width = 1 << language_id.BITS
    for t in ask:
        s = {}
        for g in "xy":
            of = {n: sum(c for (m, _), c in count[g].items() if m == n) + language_id.ALPHA * width for n in (1, 2, 3)}
            s[g] = math.log(sum(own == g for _, own in teach) / len(teach)) + sum(c * math.log((count[g][k] + language_id.ALPHA) / of[k[0]]) for k, c in grams(t).items())
        best = max(s, key=s.get)
        assert got[t].lang_pred == best and got[t].lang_score == pytest.approx(1 / sum(math.exp(x - s[best]) for x in s.values()), rel=1e-4)


def test_ngrams_do_not_depend_on_neighbours():
    def per_text(texts):
        grams, has = language_id._ngrams(texts)
        return [(([sorted(ids[doc == i].tolist()) for ids, doc in grams] + [[]])[:3], bool(has[i])) for i in range(len(texts))]

    texts = ["ab", "cd", "", "x", "1", "\u00e9t\u00e9 l\u00e0", " lead and tail "]
    alone = [per_text([t])[0] for t in texts]
    assert per_text(texts) == alone and per_text(texts[::-1]) == alone[::-1]
    assert [len(x) for x in alone[0][0]] == [2, 3, 2]  # a b, " a" ab "b ", " ab" "ab "


# ---------------------------------------------------------------- mixing


def test_schedule_stays_within_a_block():
    rng = random.Random(1)
    for _ in range(30):
        unit = mixing.units({f"s{i}": rng.random() ** 3 + 1e-6 for i in range(rng.randrange(1, 12))}, 120)
        q = sum(unit.values())
        assert q == 120
        done = Counter()
        for s, i, t in mixing.schedule(unit):
            assert i * q // unit[s] <= t < -(-(i + 1) * q // unit[s])  # between release and deadline
            done[s] += 1
            assert all(abs(done[x] - unit[x] * (t + 1) / q) < 1 for x in unit)
        assert done == unit


def test_exact_schedule_keeps_to_the_weights():
    rng = random.Random(3)
    cases = [{f"s{i}": rng.random() ** 3 + 1e-6 for i in range(k)} for k in (3, 20, 200)] + [{"a": 1.0, "b": 0.0001}]
    for weights in cases:
        total, last = sum(weights.values()), 20_000
        blocks = {s: int(w / total * last) + 2 for s, w in weights.items()}
        at = mixing.slots(mixing.exact_units(weights), blocks)
        order = sorted((t, s) for s, ts in at.items() for t in ts)
        assert len({t for t, _ in order}) == len(order) == sum(blocks.values())
        done = Counter()
        for n, (t, s) in enumerate(order):
            done[s] += 1
            if t > last:
                break
            assert t == n  # all sources last so far
            assert abs(done[s] - weights[s] / total * (t + 1)) < 1 + 1e-6
            if t % 500 == 499:
                assert all(abs(done[x] - weights[x] / total * (t + 1)) < 1 + 1e-6 for x in weights)
    assert mixing.slots(mixing.exact_units({"a": 1.0, "b": 1e-9}), {"a": 3, "b": 2}) == {"a": [0, 1, 2], "b": [3, 1000000001]}


def test_mix_follows_exact_weights(spark):
    docs = spark.range(24_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 < 3, "a").otherwise("b").alias("source"))
    got = mixing.mix(docs, weights={"a": 2.0004, "b": 0.9996}, block_docs=2).select("source", "mix_slot").distinct().collect()
    seen = sorted((r.mix_slot, r.source) for r in got)
    assert len(seen) == 12_000
    done = Counter()
    for t, s in seen[:8_000]:
        done[s] += 1
        assert abs(done["a"] - 2.0004 / 3 * (t + 1)) < 1 and abs(done["b"] - 0.9996 / 3 * (t + 1)) < 1


def test_mix_numbers_and_edges(spark, sf, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = mixing.mix(docs, block_docs=2, rows_per_bucket=3, period=60).collect()
    want = defaultdict(list)
    for r in got:
        want[r.source].append((hashlib.md5(str(r.doc_id).encode()).hexdigest(), r.doc_id, r.mix_block, r.mix_place))
    for rows in want.values():
        assert [(b, p) for _, _, b, p in sorted(rows)] == [(i // 2, i % 2) for i in range(len(rows))]
    slots = defaultdict(set)
    for r in got:
        slots[r.mix_slot].add((r.source, r.mix_block))
    assert all(len(x) == 1 for x in slots.values())
    assert mixing.mix(odd, weights={"a": 2, "b": 1}).count() == len(ODD)
    assert mixing.mix(odd.limit(0)).count() == 0
    plain = mixing.mixed(odd)
    assert plain.columns == odd.columns and sorted(map(str, plain.collect())) == sorted(map(str, odd.collect()))


# ---------------------------------------------------------------- packing


def test_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(20):
        row = rng.randrange(5, 60)
        sizes = [rng.randrange(1, row + 1) for _ in range(rng.randrange(80))]
        got = packing.best_fit_decreasing(sizes, row)
        assert sorted(i for r in got for i in r) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in r) <= row for r in got)
        plain: list[list[int]] = []
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fit = [r for r in plain if sum(sizes[j] for j in r) + sizes[i] <= row]
            if fit:
                max(fit, key=lambda r: sum(sizes[j] for j in r)).append(i)
            else:
                plain.append([i])
        assert sorted(sum(sizes[i] for i in r) for r in got) == sorted(sum(sizes[i] for i in r) for r in plain)


def test_round_trip(spark, sf, odd):
    import tiktoken

    tok = packing.Tokens(packing.VOCABULARY)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, " lead  two\n x \n\n y 'll it's\t z "), (-4, "tail ")], "doc_id long, text string"))
    rows = packing.pack(docs, row=256, pack_tokens=20_000).collect()
    got = packing.unpack(rows)
    for d, t in docs.collect():
        assert got[d].tolist() == [*tok.enc.encode_ordinary(t or ""), packing.END]
        assert tok.enc.decode(got[d][:-1].tolist()) == (t or "")
    for r in rows:
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 256 and r.position_resets == r.cu_seqlens[:-1]
        assert (np.frombuffer(bytes(r.ids), np.uint16)[r.n_tokens :] == packing.END).all()
    assert len({r.row_id for r in rows}) == len(rows)
    assert isinstance(tok.enc, tiktoken.Encoding)
    assert packing.pack(odd.limit(0)).count() == 0
    assert sum(len(r.doc_ids) for r in packing.pack(odd).collect()) >= len(ODD)


def test_a_text_is_encoded_in_one_call():
    tok = packing.Tokens(packing.VOCABULARY)
    rng = random.Random(11)
    pieces = [" ", " ", "\n", "\n\n", "\t", "\r\n", "\xa0", "\u2028", "\x1c", "a", "the", "'s", "I'll", "é", "日本", "12", "!", "..."]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(14))) for _ in range(500)]
    texts.append(" ".join(f"word{i} of, it.\nThen" for i in range(1000)))
    want = [tok.enc.encode_ordinary(t) for t in texts]

    class Counted:
        calls = 0

        def __init__(self, enc):
            self._core_bpe, self.plain = enc._core_bpe, enc.encode_ordinary

        def encode_ordinary(self, text):
            self.calls += 1
            return self.plain(text)

    tok.enc = Counted(tok.enc)
    assert [tok.encode(t).tolist() for t in texts] == want
    assert tok.enc.calls == len(texts)


def test_long_runs_and_other_ids(spark, monkeypatch):
    tok = packing.Tokens(packing.VOCABULARY)
    monkeypatch.setattr(packing, "BLANKS", re.compile(packing.BLANKS.pattern.replace("10000", "3")))
    for run in ("   ", " \n\t ", "\n\n\n", "\u3000 \xa0  ", "     "):
        for text in (f"a{run}b", f"a{run}", f"{run}b", f"a{run}!{run}7{run}{run}é", run, f"a{run}'s b"):
            assert np.frombuffer(tok.whole(text), np.uint32).tolist() == tok.enc.encode_ordinary(text)
    monkeypatch.undo()
    long = ["x" + " " * 2_000_000 + "y", " " * 2_000_000, "a" * 500_000, "\n" * 300_000 + "z"]
    df = spark.createDataFrame([(f"id{i}", t) for i, t in enumerate(long)] + [("id0", "again"), (None, "no id")], "doc_id string, text string")
    rows = packing.pack(df, row=4096).collect()
    assert sorted({d for r in rows for d in r.doc_ids if d}) == ["id0", "id1", "id2", "id3"]
    got = packing.unpack(rows)
    for i in (1, 2, 3):
        assert tok.enc.decode(got[f"id{i}"][:-1].tolist()) == long[i]


# ---------------------------------------------------------------- language model


def words(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD)), None]


def test_base_scores_and_held_out(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    c = Counter(w for d, t in docs if zlib.crc32(str(d).encode()) % 5 != 1 for w in words(t))
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in language_model.op4_language_model(spark, sf).collect()}
    assert len(got) == len(docs)
    for d, t in docs:
        w, r = words(t), got[d]
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.held_out == (zlib.crc32(str(d).encode()) % 5 == 1)
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def set_partitions(n):
    """Table sizes of every seating of n customers."""
    if n == 0:
        yield []
        return
    for rest in set_partitions(n - 1):
        for i in range(len(rest)):
            yield [*rest[:i], rest[i] + 1, *rest[i + 1 :]]
        yield [*rest, 1]


def test_tables_follow_their_exact_distribution():
    d, s, others, p0 = 0.6, 1.5, 7, 0.05
    for c in (2, 3, 5):
        weight = defaultdict(float)
        for tables in set_partitions(c):
            w = p0 ** len(tables) * math.prod(s + d * (others + j) for j in range(len(tables)))
            weight[len(tables)] += w * math.prod(k - d for size in tables for k in range(1, size))
        got = language_model.redraw(np.full(40_000, c), np.full(40_000, others), np.full(40_000, p0), d, s, language_model.stirling(language_model.EXACT, d), np.random.default_rng(c))
        for t in range(1, c + 1):
            assert (got == t).mean() == pytest.approx(weight[t] / sum(weight.values()), abs=0.01)


def test_sweeps_and_predictions():
    rng = np.random.default_rng(4)
    full = rng.poisson(0.7, (20, 50)) * rng.integers(1, 60, (20, 50))
    rest, dish = map(np.ravel, np.indices(full.shape))
    count, p0 = full.ravel(), np.full(1000, 1 / 50)
    tables = np.minimum(count, 1)
    for _ in range(3):
        tables = language_model.sweep(rest, count, tables, p0, 0.4, 3.0, rng)
        assert ((tables >= np.minimum(count, 1)) & (tables <= count)).all()
        p = language_model.predictive(rest, count, tables, p0, 0.4, 3.0)
        assert np.allclose(np.bincount(rest, weights=p), 1) and (p > 0).all()
    assert tables.sum() > (count > 0).sum()


def test_scores_know_pairs_of_words(spark):
    rng = random.Random(5)

    def text():
        out = [rng.randrange(156)]
        while len(out) < 40:
            out.append((7 * out[-1] + rng.randrange(4)) % 156)
        return " ".join(f"w{i}" for i in out)

    docs = [(i, text(), True) for i in range(60)]
    twice = text()
    docs += [(100, twice, True), (101, twice, True), (102, " ".join(sorted(twice.split())), False), (103, twice, False), (104, "never seen words", False)]
    got = {r.doc_id: r for r in language_model.score(spark.createDataFrame(docs, "doc_id long, text string, learn boolean")).collect()}
    assert got[103].score == pytest.approx(got[100].score) and got[100].score > got[100].base_score + 5
    assert got[103].base_score == pytest.approx(got[102].base_score) and got[103].score > got[102].score + 5
    assert got[104].n_known == 1
    p = [10 ** got[i].score for i in got]
    assert all(0 < x < 1 for x in p)


def test_seating_has_the_expected_number_of_tables():
    rng = np.random.default_rng(0)
    d, w, n = 0.0, 2.0, 200
    got = language_model.seat(np.full(4000, n), np.full(4000, w), d, rng).mean()
    # with no discount each customer opens a table with probability w / (w + customers before)
    assert got == pytest.approx(1 + sum(w / (w + k) for k in range(1, n)), rel=0.02)


def test_language_model_edges(odd):
    got = language_model.score(odd).collect()
    assert len(got) == len(ODD) and all(r.n_tokens >= 1 and r.score < 0 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (3, 4)} == {1}
    nothing = language_model.score(odd.withColumn("learn", F.lit(None).cast("boolean"))).collect()
    assert {(r.n_known, r.train_tokens, r.base_score) for r in nothing} == {(0, 0, 0.0)}
    assert language_model.score(odd.limit(0)).count() == 0


# ---------------------------------------------------------------- pipeline


def benchmark_documents(docs, bench):
    """Ids of the documents that hold any window of eight words (or a whole shorter item) of the benchmark."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    items = [split(r.text) for r in bench.collect()]
    windows = {(m, tuple(w[i : i + m])) for w in items if w for m in [min(8, len(w))] for i in range(len(w) - m + 1)}
    sizes = {m for m, _ in windows}
    out = set()
    for r in docs.collect():
        w = split(r.text)
        if any((m, tuple(w[i : i + m])) in windows for m in sizes for i in range(len(w) - m + 1)):
            out.add(r.doc_id)
    return out


def test_pipeline_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, sf)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name.replace(" ", "_")))
        now = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        if name.startswith("n-gram"):
            groups = link(seen, 5, 80).collect()
            assert {r.doc_id for r in now.collect()} == {r.component_id for r in groups}
        elif name.startswith("mixing"):
            assert sorted(r.doc_id for r in now.collect()) == sorted(r.doc_id for r in seen.collect())
        elif name.startswith("benchmark"):
            kept = {r.doc_id for r in now.collect()}
            hit = benchmark_documents(seen, spark.read.parquet(f"{sf}/benchmark.parquet"))
            assert hit and kept == {r.doc_id for r in seen.collect()} - hit
        else:
            assert now.count() > 0.9 * seen.count()
        seen = now
    packed = packing.unpack(corpus_pipeline.STAGES[-1][1](spark, seen, sf).collect())
    assert set(packed) == {r.doc_id for r in seen.collect()}


def test_final_rows_follow_the_mix(spark, tmp_path):
    docs = spark.range(6000).selectExpr("id AS doc_id", "concat('word ', repeat(concat(id, ' and '), 20 + id % 7 * 30)) AS text", "'en' AS lang", "CASE WHEN id % 20 = 0 THEN 'small' WHEN id < 2400 THEN 'middle' ELSE 'large' END AS source", "0L AS n_chars")
    corpus_pipeline.mixture(spark, docs, "").repartition(7, "doc_id").write.parquet(str(tmp_path / "mixed"))  # a reader may meet the rows in any order
    seen = spark.read.parquet(str(tmp_path / "mixed"))
    source, place = {}, {}
    for i, r in enumerate(mixing.mix(docs).orderBy("mix_slot", "mix_place").collect()):
        source[r.doc_id], place[r.doc_id] = r.source, i
    rows = corpus_pipeline.token_rows(spark, seen, "").orderBy("row_id").collect()
    order = list(dict.fromkeys(d for r in rows for d in r.doc_ids))
    assert sorted(order) == sorted(place)
    size = {s: sum(x == s for x in source.values()) for s in set(source.values())}
    weight = {s: n**0.7 for s, n in size.items()}
    done, total = Counter(), sum(weight.values())
    for n, d in enumerate(order[:3600], 1):
        done[source[d]] += 1
        if n % 1200 == 0:
            assert all(abs(done[s] / n - weight[s] / total) < 0.05 for s in weight)
    assert sum(abs(place[d] - i) for i, d in enumerate(order)) / len(order) < len(order) / 8


def test_pipeline_on_odd_documents(spark, sf, odd):
    seen = odd
    for _, stage in corpus_pipeline.STAGES:
        seen = stage(spark, seen, sf)
    assert seen.count() >= 1
    assert corpus_pipeline.STAGES[1][1](spark, odd.limit(0), sf).columns == odd.columns
