"""Quality rules by a log-likelihood ratio of hashed n-grams (operator 5), in DataFrame functions only.

Words and word pairs are hashed into ``buckets`` cells.  Two multinomials with additive smoothing
are estimated: one over all documents, one over trusted documents.  A document's score is the mean,
over its words and pairs, of ln(P_trusted / P_corpus); documents are kept at or above ``threshold``.
The ratios are rounded to multiples of 2^-20 and summed as integers, so neither the order of rows
nor a lost executor can move a document over the threshold.

The corpus multinomial counts every document.  The trusted one is fitted on at most ``max_trusted``
documents labelled as good, chosen by a hash of the id (documented bound): their ids are broadcast, and
the ``buckets`` ratios are a constant of the plan, so scoring is one pass without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.llm.common import WORD, staged, words_of

SYMBOLS = "#*$%&|<>"
BUCKETS = 1 << 17
SCALE = 1 << 20
_LOW = (1 << 24) - 1  # the place of a window in the text; the rest holds 40 bits of its hash
_LONG = (1 << 31) - 1  # the same for texts of more words


def base_columns(text) -> list:
    """n_words, word_chars, n_symbols, n_dup_lines of a text, all long; ``words`` and ``lines`` must be columns."""
    full = F.coalesce(text, F.lit(""))
    return [
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(full, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    ]


def lines_with_words(text):
    """The lines of a text that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(WORD))


def _same(words, p, q):
    return (F.get(words, p) == F.get(words, q)) & (F.get(words, p + 1) == F.get(words, q + 1)) & (F.get(words, p + 2) == F.get(words, q + 2))


def hashed(words):
    """Array of a 64-bit hash per word: pairs and windows are hashed from these, not from the words again."""
    return F.transform(words, lambda x: F.xxhash64(x))


def repeated_words(df: DataFrame, out: str = "n_repeat_words") -> DataFrame:
    """Adds the number of words in three-word windows that occur twice or more in ``words``.

    ``hashes`` must be a column with the words' hashes.  Windows are sorted as longs of 40 hash bits and their place (33 in texts of more than
    16 million words), so equal windows stand side by side.  Neighbours of equal hash are compared word by word;
    the windows of a hash that two different ones share are sorted again by another hash, and those
    that agree in both are compared with each other.
    """
    w, own = F.col("words"), F.col("hashes")
    n = F.size(w)
    low = F.when(n > _LOW, F.lit(_LONG)).otherwise(F.lit(_LOW)).cast("long")
    high = F.bitwise_not(low)
    none = F.array().cast("array<bigint>")

    def place(x):
        return x.bitwiseAND(low).cast("int")

    def alike(x, y):  # equal but for the place; null beyond the ends, which no filter lets pass
        return x.bitwiseXOR(y).bitwiseAND(high) == F.lit(0).cast("long")

    def side_by_side(s):
        return F.filter(s, lambda x, i: alike(x, F.get(s, i + 1)) | alike(x, F.get(s, i - 1)))

    def shared(h):  # hashes of which two neighbours are different windows
        unlike = F.filter(h, lambda x, i: alike(x, F.get(h, i + 1)) & ~_same(w, place(x), place(F.get(h, i + 1))))
        return F.array_distinct(F.transform(unlike, lambda x: x.bitwiseAND(high)))

    def parted(h, c):  # windows that repeat for certain, and those still to be looked at
        return F.when(F.size(c) == 0, h).otherwise(F.filter(h, lambda x: ~F.array_contains(c, x.bitwiseAND(high)))), F.when(F.size(c) == 0, none).otherwise(F.filter(h, lambda x: F.array_contains(c, x.bitwiseAND(high))))

    hashes = F.when(n >= 3, F.transform(F.slice(own, F.lit(1), n - 2), lambda x, i: F.xxhash64(x, F.get(own, i + 1), F.get(own, i + 2)).bitwiseAND(high))).otherwise(none)
    df = df.withColumn("_hashes", hashes)
    # As many hashes as windows: no two windows are equal, and there is nothing to sort.
    some = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    df = df.withColumn("_hits", F.when(some, F.sort_array(F.transform("_hashes", lambda x, i: x.bitwiseOR(i)))).otherwise(none))
    df = df.withColumn("_hits", side_by_side(F.col("_hits")))
    df = df.withColumn("_shared", shared(F.col("_hits")))
    sure, unsure = parted(F.col("_hits"), F.col("_shared"))
    df = df.withColumns({"_sure": sure, "_unsure": unsure}).drop("_hashes", "_hits", "_shared")
    other = F.transform("_unsure", lambda x: F.xxhash64(F.get(own, place(x) + 2), F.get(own, place(x) + 1), F.get(own, place(x))).bitwiseAND(high).bitwiseOR(x.bitwiseAND(low)))
    df = df.withColumn("_again", F.sort_array(other))
    df = df.withColumn("_again", side_by_side(F.col("_again")))
    df = df.withColumn("_shared", shared(F.col("_again")))
    sure, unsure = parted(F.col("_again"), F.col("_shared"))
    u = F.col("_unsure")
    plain = F.filter(u, lambda x: F.exists(u, lambda y: (x != y) & _same(w, place(x), place(y))))
    df = df.withColumns({"_more": sure, "_unsure": unsure}).withColumn("_places", F.sort_array(F.transform(F.concat("_sure", "_more", plain), place)))
    p = F.col("_places")
    covered = F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn(out, covered).drop("_again", "_shared", "_sure", "_unsure", "_more", "_places")


def _cell(x, buckets: int):
    return F.pmod(x, F.lit(buckets)).cast("int")


def _pair(hashes, x, i):
    return F.xxhash64(x, F.get(hashes, i + 1))


def terms(hashes, buckets: int):
    """Buckets of all words and of all pairs of neighbours, the last word paired with the end of the text.

    ``hashes`` must be a plain column with the words' hashes.
    """
    return F.concat(F.transform(hashes, lambda x: _cell(x, buckets)), F.transform(hashes, lambda x, i: _cell(_pair(hashes, x, i), buckets)))


def _looked_up(table: DataFrame, buckets: int):
    """The ratios as one constant array, read by bucket: ``buckets`` numbers, whatever the input."""
    every = table.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    in_order = F.array_sort(F.collect_list(F.struct("bucket", F.coalesce("ratio", F.lit(0)).alias("ratio"))))
    joined = every.join(table, "bucket", "left").agg(F.array_join(F.transform(in_order, lambda x: x["ratio"].cast("string")), ",").alias("all"))
    return F.split(F.lit(joined.first()["all"]), ",").cast("array<bigint>")


def ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, alpha: float = 0.5, max_trusted: int = 20_000) -> DataFrame:
    """(bucket, ratio): ln(P_trusted / P_corpus) in units of 2^-20, for the buckets that occur.

    ``trusted`` has the ids of trusted documents in ``id_col``.
    """
    chosen = trusted.select(F.col(id_col).alias("id")).filter("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(max_trusted).withColumn("good", F.lit(1))
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id", "left")
    own = own.select(F.coalesce("good", F.lit(0)).cast("long").alias("good"), hashed(words_of(F.col("text"))).alias("hashes"))
    flat = own.select("good", F.explode(terms(F.col("hashes"), buckets)).alias("bucket"))
    counts = staged(flat.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good")), "term-counts")
    n, good = (float(x or 0) for x in counts.agg(F.sum("n"), F.sum("good")).first())
    log = F.log((F.col("good") + alpha) / F.lit(good + alpha * buckets)) - F.log((F.col("n") + alpha) / F.lit(n + alpha * buckets))
    return counts.select("bucket", F.round(log * SCALE).cast("long").alias("ratio"))


def judge(docs: DataFrame, table: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = -0.35, buckets: int = BUCKETS, min_words: int = 50) -> DataFrame:
    """Per document: id, base counts, base_failed, llr (mean log-likelihood ratio) and kept.

    A null or blank text has no words: its counts are 0, it fails the base rules and its llr is 0.
    Repeated rows come back as often as they came in; other columns are ignored.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumns({"words": words_of(F.col("text")), "lines": lines_with_words(F.col("text"))})
    own = own.select("id", "words", hashed(F.col("words")).alias("hashes"), *base_columns(F.col("text")))
    own = repeated_words(own)
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    h, all_ratios = F.col("hashes"), _looked_up(table, buckets)
    both = F.transform(h, lambda x, i: F.get(all_ratios, _cell(x, buckets)) + F.get(all_ratios, _cell(_pair(h, x, i), buckets)))
    total = F.aggregate(both, F.lit(0).cast("long"), lambda a, x: a + x)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    llr = F.when(F.col("n_words") > 0, total / (2 * F.col("n_words")) / SCALE).otherwise(0.0)
    return (
        own.select(F.col("id").alias(id_col), *base, failed.alias("base_failed"), llr.alias("llr"))
        .withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
    )
