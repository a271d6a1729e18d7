"""Text functions: lines, identities, title and severity normalisers, tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What ends a line, as for Python's splitlines().
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
#: The other ends of Latin-1, one by one: Java looks them up in a table, while a set with ranges or beyond Latin-1 is slow.
OTHER_LINE_END, FAR_LINE_ENDS = r"[\r\x0b\x0c\x1c\x1d\x1e\x85]", ("\u2028", "\u2029")

# Rank scales and weights per severity.
ROLLUP_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1, "info": 0}
DETAIL_RANK = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}
SORT_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4}
SCORE_WEIGHT = {"critical": 10.0, "high": 4.0, "medium": 1.5, "low": 0.5, "info": 0.0}
SEVERITY_ALIASES = {
    "c": "critical", "crit": "critical", "critical": "critical", "h": "high", "high": "high", "m": "medium", "med": "medium",
    "medium": "medium", "moderate": "medium", "l": "low", "low": "low", "i": "info", "info": "info", "informational": "info",
}


def lookup(key: Column, table: dict, default=None) -> Column:
    """Value of a literal map, or the default."""
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def lines_of(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys..., line_num from 1, line); no line for what follows a last line end, none for null or empty text.

    The last line end is cut off first, so that each text is split once, and by a plain
    line feed where it holds no other line end."""
    t = F.col(text)
    ended = F.right(t, F.lit(1)).rlike(LINE_END)
    shorter = lambda n: F.substring(t, F.lit(1), F.length(t) - n)
    body = F.when(F.right(t, F.lit(2)) == "\r\n", shorter(2)).when(ended, shorter(1)).otherwise(t)
    some = df.filter(t != "").select(*keys, body.alias("body_"))
    other = F.col("body_").rlike(OTHER_LINE_END)
    for end in FAR_LINE_ENDS:
        other = other | F.col("body_").contains(end)
    cut = F.when(other, F.split("body_", LINE_END)).otherwise(F.split("body_", "\n"))
    exploded = some.select(*keys, F.posexplode(cut).alias("pos", "line"))
    return exploded.select(*keys, (F.col("pos") + 1).alias("line_num"), "line")


def text(column: Column) -> Column:
    """Null and empty are the same in every comparison."""
    return F.coalesce(column, F.lit(""))


def short_hash(*parts: Column, sep: str = ":", size: int = 32) -> Column:
    return F.substring(F.sha2(F.concat_ws(sep, *(text(p.cast("string")) for p in parts)), 256), 1, size)


def fingerprint(title: Column, path: Column, category: Column, agent: Column) -> Column:
    """Identity of a finding across runs."""
    return short_hash(F.lower(F.trim(text(title))), F.trim(text(path)), F.lower(F.trim(text(category))), F.lower(F.trim(text(agent))), sep="|")


def finding_id(audit: Column, title: Column, path: Column, index: Column) -> Column:
    return short_hash(audit, title, path, index)


def rollup_id(audit: Column, category: Column, title: Column, path: Column) -> Column:
    nul = F.lit("\0")
    raw = F.concat(text(audit), nul, text(category), nul, text(title), nul, text(path), nul)
    return F.concat(F.lit("rollup-"), F.substring(F.sha2(raw, 256), 1, 24))


def rollup_title(title: Column) -> Column:
    """Lower case with white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(text(title)), r"\s+", " "))


def memory_title(title: Column) -> Column:
    """Lower case without line references and without the place that follows " in"."""
    t = F.regexp_replace(F.lower(text(title)), r"(at )?line [0-9]+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r" in [a-z0-9_./-]+( [a-z0-9_./-]+)?", ""), r"\s+", " "))


def severity(raw: Column) -> Column:
    return lookup(F.lower(F.trim(raw)), SEVERITY_ALIASES, "info")


def reference_number(number: Column, prefix: str = "REF") -> Column:
    """PREFIX-0001 and so on."""
    return F.format_string(f"{prefix}-%04d", number)


# Words that keyword extraction leaves out.
STOP_WORDS = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should",
    "may", "might", "must", "shall", "can", "of", "in", "to", "for", "with", "on", "at", "from", "by", "about", "as", "into", "through", "and", "or",
    "but", "not", "no", "if", "then", "that", "this", "it", "its", "than",
]


def keywords(column: Column, most: int = 15) -> Column:
    """Distinct lower-case words of three characters or more in order, without stop words: the first ``most``."""
    words = F.transform(F.split(F.lower(text(column)), r"[ \t\r\n]+"), lambda w: F.regexp_replace(w, r"^[.,;:!?()\[\]{}\"']+|[.,;:!?()\[\]{}\"']+$", ""))
    return F.slice(F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(STOP_WORDS))), 1, most)


def shannon_entropy(s: Column) -> Column:
    """Bits per character; 0 for an empty string."""
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    n = F.length(s).cast("double")
    return -F.aggregate(
        F.array_distinct(chars), F.lit(0.0), lambda a, c: a + (n - F.length(F.replace(s, c, F.lit("")))) / n * F.log2((n - F.length(F.replace(s, c, F.lit("")))) / n)
    )


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def round1(x: Column) -> Column:
    """To one decimal, halves up, by a formula that every engine computes alike."""
    return F.floor(x * 10 + 0.5) / 10


def placed_snippet(line: Column, most: int = 200) -> Column:
    return F.substring(line, 1, most)


def redact_secrets(line: Column) -> Column:
    """Quoted literals (not dictionary keys), what an assignment assigns, and an open quote's tail are masked; twice is as once."""
    quoted = lambda q: rf"{q}(?!\*\*\*{q})[^{q}]*+{q}(?!\s*:)"
    keys = r"(?:\"[^\"]*\"|'[^']*')\s*:"
    # A key is stepped over as a whole, so that what stands between two literals is not taken for one.
    masked = F.regexp_replace(line, rf"({keys})|{quoted(chr(34))}|{quoted(chr(39))}", "$1\0")
    masked = F.regexp_replace(F.regexp_replace(masked, r"(:)\x00", "$1"), r"\x00", "\"***\"")
    masked = F.regexp_replace(masked, r"""((?:key|token|secret|passwd|password|pwd)\s*[:=]\s*)(?!["']?\*\*\*)[^\s"'#,;]+""", "$1***")
    return F.regexp_replace(masked, r"""([:=]\s*["'])(?!\*\*\*)[^"']+$""", "$1***")
