"""Operator 6: personal data by candidate generation and gradient boosting, in DataFrame functions only.

Base spans come from fixed patterns per kind with a validity check. High-recall
generators propose further spans, which may overlap base spans and one another:
written-out e-mail addresses, phone numbers in national or 00 form, IPv4 addresses
with spaced or bracketed dots, card numbers with other or mixed separators, and, as
a kind of its own, secrets: unbroken runs of key characters. Boosted trees score a
candidate by its format (length, digits, letters, separators, check digit, changes
between letters and digits) and its context (a cue word before it, an assignment, a
letter or digit next to it); the threshold is calibrated to a precision on held-out
rows. The trees are fitted on TRAINING_ROWS generated rows at most, a fixed bound,
with a fixed seed. Candidates over the threshold are added where they overlap no
base span and no earlier added span.

Positions are found without Python: a regular expression's matches and the
pieces between them, both from one-pass functions, alternate, so running sums of
their lengths are the offsets, in code points. Patterns are written so that a
search never looks at a run of characters twice (a match starts at the start of
its run or at the end of the last match) and never recurses per repetition.

Null and empty texts have no spans. Repeated rows are treated alike; an empty
table gives no rows. Texts are searched whole, whatever their length.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache, partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .common import DOC_COLUMNS, whole_text
from .quality import let

#: Kinds of base spans, and the one that only the method finds.
BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "secret"]

_LOCAL = "A-Za-z0-9._%+-"
#: Patterns of the base spans: the same matches as the plain forms in the comments.
BASE = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match.
HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}

_AT = r"(?:[\x20]{0,2}[\[({<][\x20]?(?:at|AT)[\x20]?[\])}>][\x20]{0,2}|[\x20](?:at|AT)[\x20])"
_DOT = r"(?:[\x20]{0,2}[\[({<][\x20]?(?:dot|DOT)[\x20]?[\])}>][\x20]{0,2}|[\x20](?:dot|DOT)[\x20]|\.)"
#: Generators of further candidates.
MORE = {
    "email": rf"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{{0,63}}+{_AT}[A-Za-z0-9-]{{1,63}}+(?:{_DOT}[A-Za-z0-9-]{{1,63}}+){{1,4}}",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:[\x20]?\.[\x20]?[0-9]{1,3}|\[\.\][0-9]{1,3}){3}(?![0-9.])",
    "card": r"(?<![0-9])(?:[0-9]{4}(?:[\x20./_\t-]{1,2}[0-9]{4}){3}|[0-9]{4}[\x20./_\t-][0-9]{6}[\x20./_\t-][0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:00[1-9][0-9]{0,2}(?:[\x20().-]{1,2}[0-9]{2,4}){2,4}|\(?0[1-9][0-9]{1,3}\)?[\x20./-][0-9]{3,4}(?:[\x20-][0-9]{2,4}){1,2}|(?:\([0-9]{3}\)[\x20]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4})(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{16,256}+={0,2}(?![A-Za-z0-9_+/=-])",
}
MORE_HINT = {
    "email": r"(?:at|AT)[\x20]?[\])}>]|[\x20](?:at|AT)[\x20][A-Za-z0-9-]+(?:\.[A-Za-z]|[\x20](?:dot|DOT)[\x20])",
    "ip": r"[0-9](?:[\x20]\.|\.[\x20]|\[\.\])[\x20]?[0-9]",
    "card": r"[0-9]{4}[\x20./_\t-][\x20./_\t-]?[0-9]{4}",
    "phone": r"[0-9]{3}[\x20.-][0-9]{4}|00[1-9]|0[1-9][0-9]{1,3}\)?[\x20./-][0-9]{3}",
    "secret": r"[A-Za-z0-9_+/-]{16}",
}
#: Words that announce personal data or secrets.
CUE = r"(?i)(mail|contact|write|phone|call|tel|mobile|fax|cell|reach|card|visa|credit|payment|host|server|address|token|secret|key|passw|bearer|auth)"
CUE_REACH = 40
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "secret": "[SECRET]"}

#: Bound on generated rows to fit on, and rows held out for the threshold.
TRAINING_ROWS = 4000
SEED = 20240607
PRECISION = 0.98

FEATURES = ["kind", "length", "digits", "separators", "luhn", "in_range", "cue", "letter_before", "letter_after", "changes", "spelled", "assigned"]
#: A border between a letter and a digit; an at or dot in brackets or in words; an assignment just before.
CHANGE, SPELLED, ASSIGNED = "[A-Za-z][0-9]|[0-9][A-Za-z]", r"(?i)[\[({<][\x20]?(?:at|dot)[\x20]?[\])}>]|[\x20]dot[\x20]", r"[=:][\x20]?[\"']?\z"


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]+", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def value(c: Column, i: Column) -> Column:
        d = F.ascii(c) - 48
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    parts = F.transform(F.split(F.reverse(digits), ""), value)
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10 == 0


def parts_at_most_255(text: Column) -> Column:
    """Whether every number in the text, of any length, is at most 255."""
    return ~text.rlike(r"(?<![0-9])0*+(?:[1-9][0-9]{3,}|[3-9][0-9]{2}|2[6-9][0-9]|25[6-9])(?![0-9])")


def valid(kind: str, text: Column) -> Column:
    """Whether a match of the kind's base pattern counts."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return parts_at_most_255(text)
    n = F.length(digits_of(text))
    return n.between(8, 15) if kind == "phone" else n.between(16, 19) & luhn(digits_of(text))


def spans_of(text: Column, pattern: str, hint: str, keep) -> Column:
    """array<struct<a: int, b: int, s: string>>: matches that ``keep`` takes, in code points, end exclusive."""
    none = F.array().cast("array<struct<a:int,b:int,s:string>>")
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def step(acc: Column, pair: Column) -> Column:
        a = acc["at"] + F.length(pair["g"])
        b = a + F.length(pair["m"])
        span = F.struct(a.alias("a"), b.alias("b"), pair["m"].alias("s"))
        return F.struct(b.alias("at"), F.when(keep(pair["m"]), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    accepts = lambda m: keep(m)  # noqa: E731  a function of one argument, as exists() asks

    def fold(m: Column) -> Column:
        pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(m)), m, lambda g, x: F.struct(g.alias("g"), x.alias("m")))
        return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])

    some = lambda m: F.when(F.exists(m, accepts), fold(m)).otherwise(none)
    return F.when(text.contains(hint) if hint == "@" else text.rlike(hint), let(found, some)).otherwise(none)


# -- the method's model ---------------------------------------------------


def _generated(rng: random.Random) -> tuple[str, str, int, str, str, str]:
    """(kind, span, label, text before, character before, character after) of one made-up row."""
    kind, good = rng.choice(KINDS), rng.random() < 0.5
    some = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    digits = lambda n: some(n, "0123456789")
    word = lambda low=2, high=9: some(rng.randint(low, high), "abcdefghijklmnopqrstuvwxyz")
    cues = {"email": "mail contact write", "ip": "host server address", "card": "card visa credit payment", "phone": "phone call tel mobile fax", "secret": "token secret key password bearer auth"}
    cued = rng.random() < (0.7 if good else 0.1)
    before = f"{word()} {rng.choice(cues[kind].split())}{rng.choice([': ', ' ', ' = '])}" if cued else f"{word()} {word()} "
    if kind == "email":
        name, host, top = f"{word()}{rng.choice(['', '.', '_'])}{word()}", word(), rng.choice(["com", "org", "net", "de", "co"])
        at, dot = rng.choice([(" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), (" [at] ", "."), (" (at) ", "."), ("<at>", ".")])
        span = f"{name}{at}{host}{dot}{top}" if good else rng.choice([f"{word()} at {word()}.{word()}", f"{word()} (at) {word()}.{digits(2)}", f"{word()} at {word()}.{word()}.{word()}"])
    elif kind == "ip":
        top = 255 if good else 999
        span = rng.choice([" . ", "[.]", ". ", " ."]).join(str(rng.randint(0, top)) for _ in range(4))
    elif kind == "card":
        short = rng.random() < 0.2
        body = rng.choice("3456" if good else "0123456789") + digits(13 if short else 14)
        total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, body[::-1])))
        s = body + str(-total % 10 if good else (rng.randint(1, 9) - total) % 10)
        cuts = [s[:4], s[4:10], s[10:]] if short else [s[i : i + 4] for i in range(0, 16, 4)]
        span = cuts[0] + "".join(rng.choice(["." , "/", "_", "-", " ", " - "][: 6 if good else 5]) + c for c in cuts[1:])
    elif kind == "phone":
        sep = rng.choice(" .-")
        area = f"{rng.choice('23456789')}{digits(2)}"
        forms = [f"({area}) {digits(3)}-{digits(4)}", f"{area}{sep}{digits(3)}{sep}{digits(4)}", f"00{rng.randint(1, 99)} {digits(3)} {digits(3)} {digits(3)}", f"(0{rng.randint(10, 999)}) {digits(4)} {digits(3)}", f"0{rng.randint(10, 999)}/{digits(3)} {digits(4)}"]
        span = rng.choice(forms) if good and cued else f"({area}) {digits(3)}-{digits(4)}" if good else f"{digits(3)}{sep}{digits(3)}{sep}{digits(4)}"
    else:
        size = rng.choice([20, 24, 32, 40, 48, 64])
        kinds = ["0123456789abcdef", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]
        span = some(size, rng.choice(kinds)) if good else rng.choice([word(16, 30), "-".join(word(3, 9) for _ in range(5)), digits(rng.randint(16, 24)), "/".join(word(3, 9) for _ in range(4)), f"{word(8, 12)}_{word(6, 9)}{digits(2)}", "_" * rng.randint(16, 40), "-" * rng.randint(16, 60), word(16, 30).upper()])
    edge = lambda p: rng.choice("x7") if rng.random() < p else " "
    return kind, span, int(good), before, edge(0.02 if good else 0.3), edge(0.02 if good else 0.3)


def _row_features(kind: str, span: str, before: str, left: str, right: str) -> list[float]:
    d = re.sub("[^0-9]+", "", span)
    total = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, d[::-1])))
    big = any(int(x) > 255 for x in re.findall("[0-9]+", span))
    return [
        KINDS.index(kind), len(span), len(d), len(re.sub("[A-Za-z0-9]+", "", span)), float(total % 10 == 0), float(not big),
        float(bool(re.search(CUE, before[-CUE_REACH:]))), float(bool(re.match("[A-Za-z0-9]", left))), float(bool(re.match("[A-Za-z0-9]", right))),
        len(re.findall(CHANGE, span)), float(bool(re.search(SPELLED, span))), float(bool(re.search(ASSIGNED.replace(r"\z", r"\Z"), before[-CUE_REACH:]))),
    ]


@lru_cache(maxsize=1)
def model(rows: int = TRAINING_ROWS, seed: int = SEED, precision: float = PRECISION) -> BoostedTrees:
    """The fitted and calibrated trees: half of ``rows`` to fit, half held out for the threshold."""
    rng = random.Random(seed)
    made = [_generated(rng) for _ in range(rows)]
    x = np.array([_row_features(k, s, b, left, right) for k, s, _, b, left, right in made])
    y = np.array([g for _, _, g, *_ in made], float)
    half = rows // 2
    return BoostedTrees().fit(x[:half], y[:half]).calibrate(x[half:], y[half:], precision)


def scores(kind: str, text: Column, span: Column, trees: BoostedTrees) -> Column:
    """Score of a candidate span (struct a, b, s) of ``text``."""
    s, a, b = span["s"], span["a"], span["b"]
    before = F.substring(text, F.greatest(F.lit(1), a - CUE_REACH + 1), F.least(a, F.lit(CUE_REACH)))
    near = lambda at: F.substring(text, at, F.lit(1)).rlike("[A-Za-z0-9]").cast("double")
    digits = digits_of(s)
    made = F.array(
        F.lit(float(KINDS.index(kind))),
        F.length(s).cast("double"),
        F.length(digits).cast("double"),
        F.length(F.regexp_replace(s, "[A-Za-z0-9]+", "")).cast("double"),
        luhn(digits).cast("double"),
        parts_at_most_255(s).cast("double"),
        before.rlike(CUE).cast("double"),
        F.when(a > 0, near(a)).otherwise(0.0),
        near(b + 1),
        F.size(F.regexp_extract_all(s, F.lit(CHANGE), F.lit(0))).cast("double"),
        s.rlike(SPELLED).cast("double"),
        before.rlike(ASSIGNED).cast("double"),
    )
    return let(made, lambda v: trees.column([v[i] for i in range(len(FEATURES))]))


# -- spans ----------------------------------------------------------------


def with_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds, per row, ``base`` and ``spans``: array<struct<k: int, a: int, b: int>> by kind, then start."""
    trees = model()
    t = F.coalesce(F.col(text), F.lit(""))
    over = lambda kind: lambda s: scores(kind, t, s, trees) >= trees.threshold
    plain = lambda k: lambda s: F.struct(F.lit(k).alias("k"), s["a"].alias("a"), s["b"].alias("b"))
    out = df
    for k, kind in enumerate(KINDS):
        if kind in BASE:
            out = out.withColumn(f"base_{kind}", F.transform(spans_of(t, BASE[kind], HINT[kind], partial(valid, kind)), plain(k)))
        more = spans_of(t, MORE[kind], MORE_HINT[kind], lambda m: F.lit(True))
        judged = F.filter(more, over(kind))
        none = F.array().cast("array<struct<k:int,a:int,b:int>>")
        # Most texts have none: the candidates are scored only where the generator's hint holds.
        out = out.withColumn(f"more_{kind}", F.when(t.rlike(MORE_HINT[kind]), F.transform(judged, plain(k))).otherwise(none))
    base = F.concat(*(F.col(f"base_{kind}") for kind in BASE_KINDS))
    more = F.concat(*(F.col(f"more_{kind}") for kind in KINDS))
    out = out.withColumn("base", base).withColumn("more", more)

    def add(acc: Column, s: Column) -> Column:
        return F.when(F.exists(acc, lambda x: (x["a"] < s["b"]) & (s["a"] < x["b"])), acc).otherwise(F.concat(acc, F.array(s)))

    spans = F.when(F.size("more") == 0, F.col("base")).otherwise(F.sort_array(F.aggregate("more", F.col("base"), add)))
    return out.withColumn("spans", spans).drop("more", *(f"{p}_{kind}" for p in ("base", "more") for kind in KINDS))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["k"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["a"].cast("string"), s["b"].cast("string"))), ",")


def find(df: DataFrame) -> DataFrame:
    """Per row of ``df``: doc_id, n_email, n_ip, n_card, n_phone, n_secret, base_sha256, spans, and the redacted text."""
    found = with_spans(df.select("doc_id", whole_text().alias("text")))
    count = lambda k: F.size(F.filter("spans", lambda s: s["k"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        redact(F.col("text"), F.col("spans")).alias("text"),
    )


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind's label; of overlapping spans the first to start names the joint one."""
    by_start = F.sort_array(F.transform(spans, lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), s["k"].alias("k"))))
    label = lambda s: F.element_at(F.array(*(F.lit(LABELS[k]) for k in KINDS)), s["k"] + 1)

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["a"] - acc["at"])
        more = F.concat(acc["out"], F.array(gap, label(s)))
        return F.struct(F.greatest(acc["at"], s["b"]).alias("at"), F.when(s["a"] < acc["at"], acc["out"]).otherwise(more).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(by_start, start, step, rest))


def redacted_documents(docs: DataFrame) -> DataFrame:
    """The columns of documents with personal data replaced; null texts stay null. n_chars is the new length
    where text was changed."""
    found = with_spans(docs.select(DOC_COLUMNS))
    changed = F.size("spans") > 0
    new = found.withColumn("text", F.when(changed, redact(F.col("text"), F.col("spans"))).otherwise(F.col("text")))
    return new.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(DOC_COLUMNS)
