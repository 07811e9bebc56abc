"""Secret scans: candidates by pattern, false positives removed by a random forest (DataFrame functions only).

A candidate is a run of 16 or more characters of keys that holds a digit, a value of 8 or more
characters assigned to a name that secrets have (``password=``, ``token: "``), the password of
a URL, or the first line of a private key. The pattern is wide; the forest decides. It sees a
value's length, its character classes, how likely its letters follow each other in the words
of the corpus, how much of it words of the corpus cover, the path it comes from and the
neighbouring words. It learns from labelled findings; counting, features, training and scoring
all run in the JVM.
"""

from __future__ import annotations

import math
from string import ascii_lowercase as LETTERS

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A run of key characters with a digit in it, and optional padding. Tried at the start of a run only, and never backed out of.
RUN = r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*+[0-9])[A-Za-z0-9+/_\-]{16,}+={0,2}"
_NAMES = "(?:pass|passwd|password|passphrase|pwd|secret|token|apikey|api[_-]key|access[_-]key|secret[_-]key|private[_-]key|auth|credentials?)"
#: A value assigned in the same word, the password of a URL, a private key's first line.
ASSIGNED = rf"(?i:(?<={_NAMES}[\"']?[=:][=>]?[\"']?))[^\s\"',;]{{8,200}}"
URL = r"(?<=://[^\s:/@]{1,64}:)[^\s:/@]{4,200}(?=@)"
PEM = r"-----BEGIN(?=\s|-|$)"
CANDIDATE = f"{URL}|{ASSIGNED}|{RUN}|{PEM}"
#: What a text with any of these must hold; without look-behind, which is slow over whole texts.
SOME = rf"{RUN}|://[^\s:/@]{{1,64}}:|(?i:{_NAMES})[\"']?\s*[=:]|-----BEGIN"
#: Words before a value that is assigned with blanks around the sign; the value itself.
LEAD, VALUE = rf"(?i){_NAMES}[\"']?\s*[=:][=>]?\s*$", r"[^\s\"',;]{8,200}"

#: Words that make a value look like a placeholder or a name, whatever the corpus.
PLACEHOLDERS = (
    "password", "secret", "token", "example", "sample", "test", "dummy", "placeholder", "changeme", "default", "user", "admin", "root", "config",
    "service", "server", "client", "version", "release", "build", "commit", "branch", "image", "file", "path", "data", "table", "index", "value",
    "name", "type", "string", "number", "date", "time", "year", "page", "article", "section", "chapter", "figure", "http", "https", "www", "com",
    "org", "html", "json", "yaml", "the", "and", "for", "with", "this", "that", "from", "your", "here", "insert",
)
TRUSTED = r"(?i)(pass|passwd|password|pwd|secret|token|api|apikey|key|auth|bearer|credential|access|private)"
DOUBTED = r"(?i)(commit|sha|md5|checksum|digest|uuid|guid|isbn|phone|tel|card|order|invoice|version|etag|hash|color|colour|id)"
TREES, DEPTH, SEED, THRESHOLD = 20, 8, 7, 0.5
FINDINGS = 6000  # labelled findings made when none are given
WORDS, LEAST_LETTERS = 4000, 4  # most frequent words of the corpus that count as its dictionary, and their least length


def _share(value: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(value, pattern, "")) / F.greatest(F.length(value), F.lit(1))


def dictionary(docs: DataFrame, words: int = WORDS) -> dict[str, int]:
    """The ``words`` most frequent words of 4 to 20 letters (a-z, lower-cased) over all texts, with their counts. Ties go to the first by name.

    Only that many come to the driver.
    """
    text = F.lower(F.coalesce("text", F.lit("")))
    each = docs.select(F.explode(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " ")).alias("w")).filter(F.col("w").rlike(f"^[a-z]{{{LEAST_LETTERS},20}}$"))
    return {r[0]: r[1] for r in each.groupBy("w").count().orderBy(F.desc("count"), "w").limit(words).collect()}


def transitions(words: dict[str, int]) -> dict[str, float]:
    """Two letters -> log10 probability of the second after the first in the words, with each transition counted once more."""
    n: dict[str, dict[str, int]] = {a: dict.fromkeys(LETTERS, 1) for a in LETTERS}
    for w, c in words.items():
        for a, b in zip(w, w[1:]):
            n[a][b] += c
    return {a + b: math.log10(c / sum(row.values())) for a, row in n.items() for b, c in row.items()}


def features(found: DataFrame, words: dict[str, int] | None = None) -> DataFrame:
    """``found`` (path, before, value, after) with one double for each feature, f0, f1, ... (replaced if there).

    ``words``: of :func:`dictionary`; without them only placeholders count as words and all
    transitions are alike.
    """
    found = found.drop(*[c for c in found.columns if c[0] == "f" and c[1:].isdigit()])
    v, before, after, path = (F.coalesce(F.col(c), F.lit("")) for c in ("value", "before", "after", "path"))
    n = F.greatest(F.length(v), F.lit(1))
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    changes = F.length(F.regexp_replace(shape, r"(.)\1*", "x"))  # runs of one class
    placeholders = "(?i)(" + "|".join(sorted(PLACEHOLDERS, key=lambda w: (-len(w), w))) + ")"
    parts = F.filter(F.split(F.lower(v), "[^a-z]+"), lambda x: F.length(x) >= LEAST_LETTERS)
    known = F.array(*[F.lit(w) for w in sorted(words or ())]) if words else F.array().cast("array<string>")
    covered = F.aggregate(F.array_intersect(parts, known), F.lit(0), lambda acc, x: acc + F.length(x)) / n
    steps = transitions(words or {})
    odds = F.create_map(*[F.lit(x) for kv in steps.items() for x in kv])
    pairs = F.filter(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(F.lower(v), i, F.lit(2))), lambda x: x.rlike("^[a-z]{2}$"))
    likely = F.when(F.size(pairs) > 0, F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + F.element_at(odds, x)) / F.size(pairs)).otherwise(math.log10(1 / len(LETTERS)))
    out = [
        F.length(v).cast("double"),
        1 - _share(v, "[0-9]"),
        1 - _share(v, "[a-z]"),
        1 - _share(v, "[A-Z]"),
        changes / n,
        F.size(F.array_distinct(F.split(v, ""))) / n,
        v.rlike("^[0-9a-f]+$").cast("double"),
        v.rlike("^[0-9A-F]+$").cast("double"),
        v.rlike("^[A-Z0-9]+$").cast("double"),
        v.rlike("^[0-9_/+-]+$").cast("double"),
        v.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-").cast("double"),
        v.rlike("^(AKIA|ASIA|ghp_|gho_|xox[abp]-|sk-|AIza|eyJ|-----BEGIN)").cast("double"),
        1 - _share(v, placeholders),
        covered,
        likely,
        v.rlike(r"(.)\1{3,}").cast("double"),
        (F.length(v) - F.length(F.regexp_replace(v, "[_/-]", ""))) / n,
        (F.length(v) - F.length(F.regexp_replace(v, "[^A-Za-z0-9_/+=-]", ""))) / n,
        v.rlike(r"^[<$%{(\[]").cast("double"),
        v.rlike("(?i)^(none|null|true|false|undefined|string|str|text|required|optional|os\\.|process\\.|env)").cast("double"),
        before.rlike(r"[=:][=>]?\s*[\"']?$").cast("double"),
        before.rlike(rf"(?i){_NAMES}[\"']?\s*[=:][=>]?\s*[\"']?$").cast("double"),
        before.rlike(r"://[^\s/]*:$").cast("double"),
        before.rlike(TRUSTED).cast("double"),
        before.rlike(DOUBTED).cast("double"),
        after.rlike(DOUBTED).cast("double"),
        path.rlike("(?i)(test|example|sample|doc|fixture|mock|readme)").cast("double"),
        path.rlike(r"(?i)(\.env|config|secret|settings|credential|\.ya?ml|\.ini)").cast("double"),
    ]
    return found.select("*", *[c.cast("double").alias(f"f{i}") for i, c in enumerate(out)])


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """Labelled findings of two dozen kinds: path, before, value, after, label. The same for every call."""
    h = lambda k: F.sha2(F.concat_ws("/", F.col("id").cast("string"), F.lit(str(k))).cast("binary"), 256)
    pick = lambda k, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(xs))) + 1).cast("int"))
    upper = F.upper(F.translate(F.substring(F.base64(F.unhex(h(1))), 1, 30), "+/=", "QZ7"))
    mixed = F.translate(F.base64(F.unhex(h(2))), "+/=", "xY9")
    digits = F.translate(h(3), "abcdef", "012345")
    name = pick(4, "password", "passwd", "api_key", "token", "secret", "access_key", "auth")
    quiet = pick(5, "the", "und", "of", "que", "is", "value", "")
    word = lambda k: pick(k, *PLACEHOLDERS)
    marks = pick(27, "!", "@", "#", "$", "%", "&", "*", "?", ".", "+")
    chosen = F.concat(F.substring(mixed, 1, 3), marks, F.substring(mixed, 5, 4), pick(28, "", "1", "!", "#7", "x9", ".Q2$"))  # 8 to 12 characters
    spoken = F.concat(F.initcap(word(29)), pick(30, "!", "#", "-", "$", ""), F.substring(digits, 1, 4), pick(31, "!", "@", "x", "Z"))
    equals = pick(32, "=", ": ", ' = "', ":", "=>")
    kinds = [
        (1, chosen, F.concat(name, equals)),
        (1, chosen, F.concat(F.upper(name), equals)),
        (1, F.concat(F.substring(mixed, 7, 14), marks), F.concat(name, equals)),
        (1, spoken, F.concat(name, equals)),
        (1, F.regexp_replace(F.substring(mixed, 1, 40), "[0-9]", "k"), F.concat(name, equals)),
        (1, chosen, F.concat(pick(33, "postgres", "mysql", "https", "redis", "amqp"), F.lit("://"), word(34), F.lit(":"))),
        (1, F.lit("-----BEGIN"), quiet),
        (0, F.concat(pick(35, "${", "<", "{{", "$", "%("), word(36), F.lit("_"), word(37), pick(38, "}", ">", "}}", "", ")s")), F.concat(name, equals)),
        (0, F.upper(F.concat(pick(48, "${", "$", "{{", "%"), word(49), F.lit("_"), word(50), pick(51, "}", "", "}}", "%"))), F.concat(name, equals)),
        (0, pick(39, "changeme", "undefined", "required", "optional", "password", "os.environ", "process.env", "null,null", "xxxxxxxx", "********", "<redacted>", "string;required"), F.concat(name, equals)),
        (0, F.concat(word(40), word(41)), F.concat(name, pick(42, ":", ": ", "="))),
        (0, F.concat(F.initcap(word(43)), word(44), F.lit(".")), F.concat(name, pick(45, ": ", ":"))),
        (0, F.concat(word(46), F.lit("."), word(47), F.lit("()")), F.concat(name, equals)),
        (1, F.concat(F.lit("AKIA"), F.substring(upper, 1, 16)), quiet),
        (1, F.substring(h(6), 1, 18), F.concat(name, F.lit("="))),
        (1, F.substring(h(7), 1, 40), F.concat(name, F.lit(' = "'))),
        (1, F.upper(F.substring(h(7), 1, 40)), F.concat(F.upper(name), F.lit(' = "'))),
        (1, F.substring(mixed, 1, 40), F.concat(name, F.lit(": "))),
        (1, F.concat(F.lit("ghp_"), F.substring(mixed, 1, 36)), quiet),
        (0, F.substring(digits, 1, 16), quiet),
        (0, F.substring(digits, 1, 20), pick(8, "order", "card", "phone", "isbn", "invoice", "id")),
        (0, F.substring(h(9), 1, 40), pick(10, "commit", "sha1", "checksum", "merge", "digest", "blob")),
        (0, F.concat_ws("-", F.substring(h(11), 1, 8), F.substring(h(11), 9, 4), F.substring(h(11), 13, 4), F.substring(h(11), 17, 4), F.substring(h(11), 21, 12)), pick(12, "uuid", "id:", "guid", "request")),
        (0, F.concat_ws("-", word(13), word(14), word(15), F.substring(digits, 1, 3)), pick(16, "see", "file", "build", "in", "password=")),
        (0, F.concat(pick(17, "your_", "insert_", "example_", "test_"), pick(18, "api_key", "password", "secret_token"), pick(19, "_here_123", "_0000", "_12345")), F.concat(name, F.lit("="))),
        (0, F.concat_ws("/", word(20), word(21), word(22), F.concat(F.lit("v"), F.substring(digits, 1, 2))), quiet),
        (0, F.concat(F.lit("2024-"), F.substring(digits, 1, 2), F.lit("-"), F.substring(digits, 3, 2), F.lit("T"), F.substring(digits, 5, 6)), pick(23, "at", "on", "date", "")),
    ]
    kind = F.pmod(F.xxhash64("id"), F.lit(len(kinds)))
    choose = lambda j: F.coalesce(*[F.when(kind == i, k[j] if isinstance(k[j], Column) else F.lit(k[j])) for i, k in enumerate(kinds)])
    path = pick(24, "src3", "src11", "app/config.yml", "tests/fixtures/a.txt", "docs/readme.md", ".env", "settings.ini", "web/page.html", "")
    return spark.range(n).select(path.alias("path"), choose(2).alias("before"), choose(1).alias("value"), pick(25, "and", "the", "de", "", "checksum", "mismatch").alias("after"), choose(0).cast("double").alias("label"))


def train(labelled: DataFrame, words: dict[str, int] | None = None, trees: int = TREES, depth: int = DEPTH, seed: int = SEED):
    """(assembler, forest) from findings with path, before, value, after and a label of 0 or 1; ``words``: of :func:`dictionary`."""
    f = features(labelled, words)
    names = [c for c in f.columns if c[0] == "f" and c[1:].isdigit()]
    put = VectorAssembler(inputCols=names, outputCol="_features")
    forest = RandomForestClassifier(featuresCol="_features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed)
    return put, forest.fit(put.transform(f).select("_features", "label"))


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """doc_id, path, word_no, value_no, before, value, after of every candidate in the whole texts.

    Only texts that may hold a candidate are split into words. Null and empty texts have none; a null
    or missing path is empty. Rows that repeat are scanned each. A very long run of characters
    is read once. Of ``docs`` only doc_id, text and the path are used.
    """
    p = F.coalesce(F.col(path).cast("string"), F.lit("")) if path in docs.columns else F.lit("")
    some = docs.select("doc_id", p.alias("path"), "text").filter(F.col("text").rlike(SOME))

    def around(ws):
        at = lambda i: F.coalesce(F.get(ws, i), F.lit(""))
        lead = lambda i: F.concat_ws(" ", at(i - 2), at(i - 1))
        hits = F.filter(F.sequence(F.lit(0), F.size(ws) - 1), lambda i: F.get(ws, i).rlike(CANDIDATE) | ((F.length(F.get(ws, i)) >= 8) & F.substring(lead(i), -80, 80).rlike(LEAD)))
        return F.transform(hits, lambda i: F.struct(i.alias("word_no"), lead(i).alias("lead"), at(i).alias("word"), at(i + 1).alias("after")))

    found = F.flatten(F.transform(F.array(F.split("text", r"\s+")), around))
    each = some.select("doc_id", "path", F.explode(found).alias("x")).select("doc_id", "path", "x.*")
    own = F.regexp_extract_all("word", F.lit(CANDIDATE), F.lit(0))
    # a value with blanks before it is taken whole, once
    led = F.when(F.substring("lead", -80, 80).rlike(LEAD), F.regexp_extract_all("word", F.lit(VALUE), F.lit(0)))
    values = each.select("*", F.posexplode(F.when(F.size(led) > 0, led).otherwise(own)).alias("value_no", "value"))
    before = F.concat_ws(" ", "lead", F.expr("substring(word, 1, locate(value, word) - 1)"))
    return values.select("doc_id", "path", "word_no", "value_no", before.alias("before"), "value", F.concat_ws(" ", F.regexp_extract("word", r"([\"'])[^\"']*$", 1), "after").alias("after"))


def scan(docs: DataFrame, labelled: DataFrame | None = None, path: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """The candidates of :func:`candidates` with score (the forest's probability) and secret (score at least the threshold).

    The dictionary is that of all of ``docs``. Columns of ``docs`` other than doc_id, text and
    the path are not read, whatever their names. An empty table has no candidates.
    """
    words = dictionary(docs)
    put, forest = train(labelled_findings(docs.sparkSession) if labelled is None else labelled, words)
    found = features(candidates(docs, path), words)
    scored = forest.transform(put.transform(found)).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "path", "word_no", "value_no", "before", "value", "after", "score", (F.col("score") >= threshold).alias("secret"))


def redact(docs: DataFrame, mark: str = "[SECRET]", **how) -> DataFrame:
    """``docs`` with every secret found in a text replaced there by ``mark``, longer ones first.

    Of a private key only the first line's ``-----BEGIN`` is a finding. Rows with a null doc_id
    are matched by their text, as are rows that repeat a doc_id.
    """
    key = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text"))
    keyed = docs.select(key.alias("doc_id"), "text", *[c for c in [how.get("path", "source")] if c in docs.columns and c not in ("doc_id", "text")])
    found = scan(keyed, **how).filter("secret").groupBy(F.col("doc_id.id").alias("_d"), F.col("doc_id.text").alias("_t")).agg(F.collect_set("value").alias("_values"))
    longest = F.reverse(F.array_sort(F.transform(F.coalesce("_values", F.array().cast("array<string>")), lambda v: F.struct(F.length(v).alias("n"), v.alias("v")))))
    text = F.aggregate(longest, F.col("text"), lambda t, x: F.replace(t, x["v"], F.lit(mark)))
    names = docs.columns
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_d"]) & (F.xxhash64(docs["text"]) == found["_t"]), "left").select(*[text.alias("text") if c == "text" else docs[c] for c in names])


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    return out.select("doc_id", "word_no", "value_no", F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), F.length("value").alias("length"), "score", "secret")
