"""Operator 5: quality rules and distribution divergence, in DataFrame functions only.

Rules count words, word characters, symbols, repeated lines and words in repeated
8-word windows. The method's verdict compares two histograms of a document with
those of its language: character classes, and common function words. The
references are the summed histograms of all documents of the language that pass
the rules; the measure is the Jensen-Shannon distance (square root of the
divergence, base 2, from 0 to 1). A histogram of few words is mostly noise, so
the distance that a document may have grows as it gets shorter.

Null and empty texts have no words and fail the rules. A null language is a
language of its own. Repeated rows are judged alike; an empty table gives no rows.
Work per row is linear, but for sorting the windows of a text that repeats any.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import DOC_COLUMNS, SPACE_CLASS, Stage, whole_text

WINDOW_WORDS = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30

#: (least words, limit), longest first: a document further from its language than the limit of its length
#: is rejected. Set on labelled documents: of good ones of each length about 1 % or fewer lie beyond.
MOST_CLASS_DISTANCE = [(60, 0.25), (LEAST_WORDS, 0.32)]
MOST_COMMON_DISTANCE = [(150, 0.23), (100, 0.26), (80, 0.28), (60, 0.30), (40, 0.32), (LEAST_WORDS, 0.38)]

# Frequent function words of English, French, German and Spanish.
COMMON_WORDS = [
    *("the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "on", "was", "be", "with", "as", "by", "this", "are"),
    *("de", "la", "le", "les", "et", "des", "que", "un", "une", "est", "en", "du", "pour", "qui", "dans"),
    *("der", "die", "das", "und", "den", "von", "zu", "ist", "mit", "ein", "nicht", "sich"),
    *("el", "los", "las", "y", "por", "con", "del", "se", "una", "no"),
]
#: Character classes; what none of them takes is a class of its own.
CHARACTER_CLASSES = ["[aeiou]+", "[b-df-hj-np-tv-z]+", "[A-Z]+", "[0-9]+", "[ \\t-\\r]+", "[.,;:!?'\"()-]+", "[\\x21-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7E&&[^.,;:!?'\"()-]]+"]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also inside of lambda functions."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(windows: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more in the array of window hashes."""
    by_hash = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        def flag(x: Column, k: Column) -> Column:
            same_before = (k > 0) & (F.get(s, k - 1)["h"] == x["h"])
            same_after = (k < F.size(s) - 1) & (F.get(s, k + 1)["h"] == x["h"])
            return F.when(same_before | same_after, x["i"])

        return F.sort_array(F.filter(F.transform(s, flag), lambda p: p.isNotNull()))

    def step(acc: Column, p: Column) -> Column:
        end = p + WINDOW_WORDS
        return F.struct(end.cast("long").alias("end"), (acc["n"] + end - F.greatest(acc["end"], p)).cast("long").alias("n"))

    zero = F.lit(0).cast("long")
    counted = F.aggregate(let(by_hash, places), F.struct(zero.alias("end"), zero.alias("n")), step, lambda acc: acc["n"])
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), zero).otherwise(counted)


def features(df: DataFrame) -> DataFrame:
    """Per row: doc_id, text_key, lang, the rules' counts, base_failed, and the histograms."""
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    known = df.select("doc_id", "lang", whole_text().alias("text"))
    cut = known.withColumn("words", F.array_remove(F.split(text, SPACE_CLASS), "")).withColumn("lines", lines)
    n = F.size("words")
    windows = F.when(
        n > WINDOW_WORDS,
        F.transform(F.sequence(F.lit(1), n - WINDOW_WORDS + 1), lambda i: F.xxhash64(F.slice("words", i, WINDOW_WORDS))),
    ).otherwise(F.array().cast("array<long>"))
    common = F.filter("words", lambda w: F.lower(w).isin(COMMON_WORDS))
    cut = cut.withColumn("windows", windows).withColumn("common", F.concat(F.lit(" "), F.lower(F.array_join(common, "  ")), F.lit(" ")))
    chars = F.length(text)
    without = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    counts = cut.select(
        "doc_id",
        F.xxhash64("text").alias("text_key"),
        "lang",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (chars - without(r"[#*$%&|<>]+")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("windows")).alias("n_repeat_words"),
        chars.cast("long").alias("chars"),
        F.array(*((chars - without(c)).cast("long") for c in CHARACTER_CLASSES)).alias("classes"),
        F.array(*(((F.length("common") - F.length(F.replace("common", F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("long") for w in COMMON_WORDS)).alias("commons"),
    )
    rest = lambda whole, parts: F.concat(parts, F.array(F.col(whole) - F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x)))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return counts.withColumns({"classes": rest("chars", F.col("classes")), "commons": rest("n_words", F.col("commons")), "base_failed": failed})


def references(found: DataFrame) -> DataFrame:
    """Per language: the summed histograms of its documents that pass the rules."""
    sums = lambda name, size: F.array(*(F.sum(F.col(name)[i]) for i in range(size))).alias(f"ref_{name}")
    return (
        found.filter(~F.col("base_failed"))
        .groupBy(F.col("lang").alias("ref_lang"))
        .agg(sums("classes", len(CHARACTER_CLASSES) + 1), sums("commons", len(COMMON_WORDS) + 1))
    )


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms; 0 if either is empty."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    share = lambda a: let(total(a), lambda t: F.transform(a, lambda x: F.when(t > 0, x / t).otherwise(0.0)))
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    both = F.zip_with(share(p), share(q), lambda x, y: (term(x, (x + y) / 2) + term(y, (x + y) / 2)) / 2)
    some = (total(p) > 0) & (total(q) > 0)
    return F.when(some, F.sqrt(F.greatest(F.lit(0.0), total(both)))).otherwise(0.0)


def limit(by_length: list[tuple[int, float]]) -> Column:
    """The limit for a document of n_words; 1, which no distance exceeds, below the last length."""
    return F.coalesce(*(F.when(F.col("n_words") >= n, F.lit(most)) for n, most in by_length), F.lit(1.0))


def judge(df: DataFrame) -> DataFrame:
    """Per row of ``df``: doc_id, the counts, base_failed, kept, class_distance, common_distance, text_key."""
    found = Stage(features(df), "features").read()
    # A row per language: joined by broadcast if its size, known from the written table, allows.
    refs = Stage(references(found), "references").read()
    met = found.join(refs, found.lang.eqNullSafe(refs.ref_lang), "left")
    far = lambda name: F.coalesce(js_distance(F.col(name), F.col(f"ref_{name}")), F.lit(0.0))
    met = met.withColumn("class_distance", far("classes")).withColumn("common_distance", far("commons"))
    odd = (F.col("class_distance") > limit(MOST_CLASS_DISTANCE)) | (F.col("common_distance") > limit(MOST_COMMON_DISTANCE))
    return met.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~odd).alias("kept"), "class_distance", "common_distance", "text_key"
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """The columns of documents, rows that the rules and the verdict keep."""
    good = judge(docs).filter("kept").select(F.col("doc_id").alias("k_id"), F.col("text_key").alias("k_text")).distinct()
    known = docs.select(DOC_COLUMNS).withColumn("k_row", F.xxhash64(whole_text()))
    met = known.join(good, known.doc_id.eqNullSafe(F.col("k_id")) & (F.col("k_row") == F.col("k_text")), "left_semi")
    return met.select(DOC_COLUMNS)
