"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counting and scoring run in numpy over Arrow batches. The log-probability matrix has a
fixed number of rows (n-gram buckets) and one column per learned language, so what is
broadcast does not grow with the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, map_arrow, packed, positional, unpacked

ORDERS, BITS, ALPHA = (1, 2, 3), 15, 0.5
MAX_LANGS = 500  # languages at most: bounds the matrix that is broadcast, 393 kB for each
TRAIN_DOCS_PER_LANG = 4000  # bound of the training sample, for each language
_SLICE_CHARS = 1 << 20
_tables: dict = {}


def _letters() -> np.ndarray:
    """Code point -> lower-case letter, or a blank for anything that is not a letter."""
    if "fold" not in _tables:
        fold = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                fold[c] = ord(low) if len(low) == 1 else c
        _tables["fold"] = fold
    return _tables["fold"]


def _runs(texts: list[str | None]):
    """Runs of texts of about a million characters; a longer text is a run of its own."""
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j] or "") <= _SLICE_CHARS):
            n += len(texts[j] or "")
            j += 1
        yield i, [t or "" for t in texts[i:j]]
        i = j


def _ngrams(texts: list[str]):
    """(feature ids of one order, document of each) for each order, and the documents that have a letter.

    Features never cross documents: each text is framed by two blanks of its own.
    """
    joined = "".join(f" {t} " for t in texts)
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    cp = _letters()[raw]
    doc = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])  # of each position
    letter = cp != 32
    has = np.zeros(len(texts), bool)
    has[doc[letter]] = True
    grams = []
    c = cp.astype(np.uint64)
    for k, n in enumerate(ORDERS):
        m = len(c) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        live = np.zeros(m, bool)
        for j in range(n):
            h = (h ^ c[j : j + m]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            live |= letter[j : j + m]
        h = (h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)
        d = doc[:m]
        live &= d == doc[n - 1 :]
        grams.append((h[live].astype(np.int64) + (k << BITS), d[live]))
    return grams, has


def _count(batches):
    """Per language: the counts of all features, one row per task."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in sorted(set(langs)):
            own = [t for t, g in zip(texts, langs) if g == lang]
            acc = total.setdefault(lang, np.zeros(len(ORDERS) << BITS, np.int64))
            for _, run in _runs(own):
                for ids, _ in _ngrams(run)[0]:
                    acc += np.bincount(ids, minlength=len(acc))
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([packed(v) for v in total.values()], pa.binary())], names=["lang", "counts"])


def _merge(table: pa.Table) -> pa.Table:
    acc = np.zeros(len(ORDERS) << BITS, np.int64)
    for x in table.column("counts").to_pylist():
        acc += unpacked(x)
    return pa.table({"lang": table.column("lang")[:1], "counts": pa.array([packed(acc)], pa.binary())})


def train(labelled: DataFrame, docs_per_lang: int = TRAIN_DOCS_PER_LANG) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log priors, log probabilities [feature, language]) from rows of doc_id, text, lang.

    At most about ``docs_per_lang`` rows of each language are used, chosen by a hash of doc_id;
    priors count all labelled rows. Rows with a null lang or text teach nothing. More than
    ``MAX_LANGS`` languages are refused.
    """
    ok = labelled.filter(F.col("lang").isNotNull())
    sizes = {r[0]: r[1] for r in ok.groupBy("lang").count().limit(MAX_LANGS + 1).collect()}
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros(0), np.zeros((len(ORDERS) << BITS, 0), np.float32)
    share = F.create_map(*[x for g in langs for x in (F.lit(g), F.lit(min(1.0, docs_per_lang / sizes[g])))])
    sample = ok.filter(F.col("text").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003))
    counted = map_arrow(sample.select("text", "lang"), _count, "lang string, counts binary").groupBy("lang").applyInArrow(_merge, "lang string, counts binary")
    got = {r[0]: unpacked(bytes(r[1])) for r in counted.collect()}
    c = np.stack([got.get(g, np.zeros(len(ORDERS) << BITS, np.int64)) for g in langs], axis=1).astype(np.float64) + ALPHA
    for k in range(len(ORDERS)):
        part = slice(k << BITS, (k + 1) << BITS)
        c[part] /= c[part].sum(axis=0)
    prior = np.log(np.array([sizes[g] for g in langs], float) / sum(sizes.values()))
    return langs, prior, np.log(c).astype(np.float32)


def _score(texts: list[str | None], langs: list[str], prior: np.ndarray, logp: np.ndarray) -> tuple[list[str], np.ndarray]:
    pred, score = ["und"] * len(texts), np.zeros(len(texts))
    if not langs:
        return pred, score
    cols = [np.ascontiguousarray(logp[:, j]) for j in range(len(langs))]
    for first, run in _runs(texts):
        grams, has = _ngrams(run)
        s = np.tile(prior, (len(run), 1))
        for ids, doc in grams:
            for j, col in enumerate(cols):
                s[:, j] += np.bincount(doc, weights=col[ids], minlength=len(run))
        best = s.argmax(axis=1)
        p = 1.0 / np.exp(s - s[np.arange(len(run)), best][:, None]).sum(axis=1)
        for i in np.flatnonzero(has):
            pred[first + i], score[first + i] = langs[best[i]], p[i]
    return pred, score


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """``docs`` with lang_pred and lang_score (columns of those names are replaced).

    The language with the largest posterior over the whole text; ties go to the first in
    name order. A text that is null or has no letter is ``und`` with score 0, as is every
    text when nothing was learned. Other columns, clashing names included, pass through.
    """
    spark = docs.sparkSession
    keep = docs.drop("lang_pred", "lang_score")
    at = keep.schema.fieldNames().index("text")
    shared = spark.sparkContext.broadcast(model)
    schema = T.StructType([*keep.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])

    def run(batches):
        langs, prior, logp = shared.value
        for b in batches:
            pred, score = _score(b.column(at).to_pylist(), langs, prior, logp)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score)], names=[*b.schema.names, "lang_pred", "lang_score"])

    return map_arrow(keep, run, schema)


def accepted(docs: DataFrame, model, min_score: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is known with a posterior of ``min_score`` at least."""
    plain, back = positional(docs)
    out = identify(plain, model)
    return back(out.filter((F.col("lang_pred") != "und") & (F.col("lang_score") >= min_score)))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.filter(~held_out(F.col("doc_id"), 0)))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id"), 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
