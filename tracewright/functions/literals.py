"""What a line has to hold for a pattern to match it, read off the pattern: literals are found faster than patterns fail."""

from __future__ import annotations

import re
import warnings
from collections import Counter
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

try:
    from re import _parser
except ImportError:  # before Python 3.11
    import sre_parse as _parser

#: Most literals of a clause, and most single characters of a set.
MOST, MOST_OF_SET = 12, 4
#: Shortest run that is looked for by itself.
LONG_RUN = 8
#: Escapes and flags that Java and Python read alike, or that say nothing of literals.
OTHER_ESCAPES, SAME_FLAGS = set("QEvhHRXGNpPkZz0cea"), set("ims")
#: Bits that one long holds.
FLAGS_A_MASK = 62

Clause = frozenset
DIGITS = Clause("0123456789")


@cache
def needed(pattern: str) -> tuple[Clause, ...]:
    """Sets of lower-case literals; every line that the (Java) pattern matches holds, in lower case, one of each set.
    None where nothing is known for sure."""
    return tuple(sorted({_least(c) for c in _sequence(_parsed(pattern)) if _is_telling(c)}, key=lambda c: (len(c), sorted(c))))


def run_in(pattern: str) -> str | None:
    """A pattern of a long run of few ASCII letters and digits that every match holds, if there is one: what stands
    around the run is slow to fail at each place of a line."""
    for op, arg in _parsed(pattern):
        if str(op) == "MAX_REPEAT" and arg[0] >= LONG_RUN and len(arg[2]) == 1 and str(arg[2][0][0]) == "IN":
            some = set()
            for kind, x in arg[2][0][1]:
                some |= set(range(x[0], x[1] + 1)) if str(kind) == "RANGE" else {x} if str(kind) == "LITERAL" else {-1}
            if all(0 <= c < 128 and chr(c).isalnum() for c in some):
                return f"[{''.join(map(chr, sorted(some)))}]{{{arg[0]}}}"
    return None


def _parsed(pattern: str):
    """Python's reading of a pattern, or nothing where Java might read it otherwise."""
    bare = re.sub(r"\\.", "", pattern)
    if OTHER_ESCAPES & set(re.findall(r"\\(.)", pattern)) or re.search(r"\[[^\]]*\[|\[.*&&", bare):
        return []
    if any(set(flags) - SAME_FLAGS for flags in re.findall(r"\(\?([A-Za-z-]+)[:)]", bare)):
        return []
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            return _parser.parse(pattern)
    except (re.error, Warning):
        return []


def _is_telling(clause: Clause) -> bool:
    """Whether few lines of prose hold a literal of the clause."""
    return clause == DIGITS or not any(len(w) == 1 and (w.isalnum() or w in " .,") for w in clause)


def _least(clause: Clause) -> Clause:
    """Without literals that hold another one."""
    return Clause(w for w in clause if not any(v != w and v in w for v in clause))


def _sequence(parts) -> list[Clause]:
    found, run = [], ""
    for op, arg in [*parts, (None, None)]:
        only = _characters(op, arg)
        if only and len(only) == 1:
            run += next(iter(only))
            continue
        if run:
            found.append(Clause([run]))
            run = ""
        if only:
            found.append(only)
        elif op is not None:
            found += _group(str(op), arg)
    return found


def _characters(op, arg) -> Clause | None:
    """The characters, in lower case, of which a part takes exactly one, where they are few and ASCII."""
    if str(op) == "LITERAL":
        codes = [arg]
    elif str(op) == "IN" and [(str(o), a) for o, a in arg] == [("RANGE", (48, 57))]:
        return DIGITS
    elif str(op) == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
        codes = [a for _, a in arg]
    else:
        return None
    some = Clause(chr(c).lower() for c in codes)
    return some if len(some) <= MOST_OF_SET and all(c < 128 for c in codes) else None


def _group(op: str, arg) -> list[Clause]:
    if op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        return _sequence(arg[2]) if arg[0] else []
    if op == "SUBPATTERN":
        return _sequence(arg[3])
    if op == "ATOMIC_GROUP":
        return _sequence(arg)
    if op != "BRANCH":
        return []
    ways = [[c for c in _sequence(b) if _is_telling(c)] for b in arg[1]]
    if not all(ways):
        return []
    # Of each way the clause whose shortest literal is longest.
    union = Clause().union(*(max(w, key=lambda c: (min(map(len, c)), -len(c), sorted(c))) for w in ways))
    return [union] if len(union) <= MOST else []


def holds(lowered: Column, clause: Clause) -> Column:
    # Characters one by one, not as a range, are a table in Java's patterns.
    return lowered.rlike("[0123456789]") if clause == DIGITS else reduce(Column.__or__, (lowered.contains(w) for w in sorted(clause)))


def may_match(lowered: Column, clauses) -> Column:
    return reduce(Column.__and__, (holds(lowered, c) for c in clauses), F.lit(True))


def masks(line: Column, lowered: Column, tests: list[tuple[str, Column]]) -> list[Column]:
    """Longs of ``FLAGS_A_MASK`` bits: bit i is set where test i, made of a pattern and a condition that holds only where the
    pattern matches, holds. A condition is not evaluated on lines (given also in lower case) without the pattern's literals, and
    tests that need the same mark, as a bracket, look for it once."""
    marks = [[c for c in needed(p) if all(len(w) == 1 for w in c)] for p, _ in tests]
    often = Counter(c for some in marks for c in some)
    none = F.lit(0).cast("long")
    out = []
    for k in range(0, len(tests), FLAGS_A_MASK):
        groups: dict[Clause | None, list[Column]] = {}
        for i, (pattern, condition) in enumerate(tests[k : k + FLAGS_A_MASK]):
            mark = max(marks[k + i], key=lambda c: (often[c], sorted(c)), default=None)
            run = run_in(pattern)
            hit = may_match(lowered, [c for c in needed(pattern) if c != mark])
            hit = (hit & line.rlike(run) if run and "(?i" not in pattern else hit) & condition
            groups.setdefault(mark, []).append(F.when(hit, F.lit(1 << i).cast("long")).otherwise(none))
        bits = [(mark, reduce(Column.bitwiseOR, some)) for mark, some in groups.items()]
        out.append(reduce(Column.bitwiseOR, (F.when(holds(lowered, mark), b).otherwise(none) if mark else b for mark, b in bits)))
    return out


def is_set(i: int, prefix: str) -> Column:
    """Test i of the masks in columns (prefix)0, (prefix)1, ..."""
    return F.col(f"{prefix}{i // FLAGS_A_MASK}").bitwiseAND(F.lit(1 << i % FLAGS_A_MASK).cast("long")) != 0
