"""Induced suffix sorting with common-prefix values, array-wise and with queues that go to disk.

Suffixes are classed as L (greater than the next one) or S; those of type S behind an
L suffix (LMS) are sorted first, by a first induction over LMS substrings and a
recursion over their names; then all L suffixes are induced from them by a scan in
ascending order, and all S suffixes from the L ones by a scan in descending order
(Nong, Zhang and Chan, 2009; Bingmann, Fischer and Osipov, 2013). A scan pops the
bucket of a symbol from a queue and pushes the preceding suffixes into the queues of
theirs: each push carries the suffix and the length of the prefix that it shares with
the one pushed before it into that bucket, one more than the least common prefix met
since. A bucket is handled in waves, each a few array operations, so that a run of
one symbol costs a wave per repetition and anything else a wave per bucket.

Queues hold at most MOST_HELD entries in memory; beyond it their chunks are written
to a folder of the caller's, which on a cluster is the shared one. Names of a
recursion beyond MOST_BUCKETS symbols are ranked by doubling instead of by bucket.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyarrow import fs as pafs

#: Entries of a queue in memory.
MOST_HELD = 1 << 22
#: Symbols up to which a recursion is induced by buckets.
MOST_BUCKETS = 2048


class Queues:
    """A queue of (suffix, common prefix) per symbol; pops come in the order of pushes. Chunks beyond MOST_HELD entries go to ``folder``."""

    def __init__(self, symbols: int, folder: str | None):
        self.chunks: list[list] = [[] for _ in range(symbols)]
        self.held, self.folder, self.spilled = 0, folder, 0

    def push(self, symbol: int, suffixes: np.ndarray, common: np.ndarray) -> None:
        self.chunks[symbol].append((suffixes, common))
        self.held += len(suffixes)
        if self.folder and self.held > MOST_HELD:
            self._spill()

    def _place(self, name: str):
        system, root = pafs.FileSystem.from_uri(self.folder)
        return system, f"{root}/{name}"

    def _spill(self) -> None:
        system, path = self._place(f"queue-{uuid.uuid4().hex}")
        system.create_dir(path.rpartition("/")[0], recursive=True)
        at = 0
        with system.open_output_stream(path) as out:
            for queue in self.chunks:
                for i, chunk in enumerate(queue):
                    if isinstance(chunk[0], np.ndarray):
                        raw = chunk[0].astype("<i8").tobytes() + chunk[1].astype("<i4").tobytes()
                        out.write(raw)
                        queue[i] = (path, at, len(chunk[0]))
                        at += len(raw)
        self.held, self.spilled = 0, self.spilled + 1

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        queue, self.chunks[symbol] = self.chunks[symbol], []
        parts = []
        for chunk in queue:
            if isinstance(chunk[0], np.ndarray):
                self.held -= len(chunk[0])
                parts.append(chunk)
            else:
                path, at, n = chunk
                system, _ = pafs.FileSystem.from_uri(self.folder)
                with system.open_input_file(path) as file:
                    raw = file.read_at(12 * n, at)
                parts.append((np.frombuffer(raw, "<i8", n).astype(np.int64), np.frombuffer(raw, "<i4", n, 8 * n).astype(np.int32)))
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        return tuple(np.concatenate(x) for x in zip(*parts)) if len(parts) > 1 else parts[0]


def _range_minima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minima of values[low..high], both ends within."""
    width = high - low + 1
    level = np.frompyfunc(int.bit_length, 1, 1)(width).astype(np.int64) - 1 if len(width) < 64 else np.log2(width).astype(np.int64)
    out, row, size = np.empty(len(low), values.dtype), values, 0
    for k in range(int(level.max()) + 1 if len(level) else 0):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(row[low[at]], row[high[at] - (1 << k) + 1])
        size = 1 << k
        if len(row) > size:
            row = np.minimum(row[:-size], row[size:])
    return out


class _Scan:
    """One scan of an induction: takes scanned suffixes in order and pushes their predecessors of the wanted type."""

    def __init__(self, s: np.ndarray, wanted: np.ndarray, symbols: int, cap: int, lcp: bool, folder: str | None):
        self.s, self.wanted, self.cap, self.lcp = s, wanted, cap, lcp
        self.queues = Queues(symbols, folder)
        #: Per bucket the least common prefix met since its last push; -1 before the first.
        self.since = np.full(symbols, -1, np.int32)

    def feed(self, suffixes: np.ndarray, common: np.ndarray) -> None:
        """``common[i]`` is what a suffix shares with the one scanned before it."""
        if not len(suffixes):
            return
        at = np.flatnonzero(suffixes > 0)
        at = at[self.wanted[suffixes[at] - 1]]
        before = suffixes[at] - 1
        symbol = self.s[before]
        order = np.argsort(symbol, kind="stable")
        at, before, symbol = at[order], before[order], symbol[order]
        starts = np.flatnonzero(np.r_[True, symbol[1:] != symbol[:-1]]) if len(symbol) else np.zeros(0, np.int64)
        ends = np.r_[starts[1:], len(symbol)]
        if not self.lcp:
            none = np.zeros(len(before), np.int32)
            for a, b in zip(starts.tolist(), ends.tolist()):
                self.queues.push(int(symbol[a]), before[a:b], none[a:b])
            return
        # Common prefixes within the block: from behind the last push of the same symbol, or from the block's start.
        low = np.r_[0, at[:-1] + 1] if len(at) else at
        low[starts] = 0
        least = _range_minima(common, low, at)
        first = symbol[starts]
        known = self.since[first]
        least[starts] = np.minimum(least[starts], known)
        made = np.minimum(least + 1, self.cap).astype(np.int32)
        made[starts[known < 0]] = 0
        self.since = np.where(self.since < 0, self.since, np.minimum(self.since, common.min()))
        if len(starts):
            last = at[ends - 1]
            rest = np.full(len(last), self.cap, np.int32)
            some = np.flatnonzero(last + 1 < len(common))
            rest[some] = _range_minima(common, last[some] + 1, np.full(len(some), len(common) - 1))
            self.since[first] = rest
        for a, b in zip(starts.tolist(), ends.tolist()):
            self.queues.push(int(symbol[a]), before[a:b], made[a:b])

    def bucket(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        """All suffixes of the bucket in scan order with their common prefixes, fed back in waves."""
        waves = []
        while True:
            suffixes, common = self.queues.pop(symbol)
            if not len(suffixes):
                break
            waves.append((suffixes, common))
            self.feed(suffixes, common)
        if not waves:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        return tuple(np.concatenate(x) for x in zip(*waves))


def _types(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether suffixes are of type S, and the length of the run of equal symbols that each starts. The last symbol is the least."""
    change = np.flatnonzero(s[1:] != s[:-1])
    next_change = np.repeat(change, np.diff(np.r_[-1, change]))
    is_s = np.r_[s[next_change + 1] > s[next_change], True]
    return is_s, np.r_[next_change - np.arange(len(s) - 1) + 1, 1]


def _induce(s: np.ndarray, is_s: np.ndarray, run: np.ndarray, lms: np.ndarray, lms_common: np.ndarray, symbols: int, cap: int, lcp: bool, folder: str | None):
    """Suffix array and common prefixes with the suffix before, from LMS suffixes in order (their own common prefixes beside them)."""
    present = np.flatnonzero(np.bincount(s, minlength=symbols)).tolist()
    of = s[lms]
    cuts = np.searchsorted(of, np.arange(symbols + 1))  # sorted LMS suffixes stand by their symbol
    zero = np.zeros(0, np.int32)
    up, l_parts = _Scan(s, ~is_s, symbols, cap, lcp, folder), {}

    def seam(x: int, y: int) -> int:
        return min(int(run[x]), int(run[y]), cap)

    for c in present:
        suffixes, common = up.bucket(c)
        l_parts[c] = (suffixes, common)
        mine, theirs = lms[cuts[c] : cuts[c + 1]], lms_common[cuts[c] : cuts[c + 1]].copy()
        if len(mine):
            theirs[0] = seam(int(suffixes[-1]), int(mine[0])) if len(suffixes) else 0
            up.feed(mine, theirs)
    down, s_parts = _Scan(s, is_s, symbols, cap, lcp, folder), {}
    for c in reversed(present):
        suffixes, common = down.bucket(c)
        s_parts[c] = (suffixes, common)
        l_suffixes, l_common = l_parts[c]
        if len(l_suffixes):
            # Descending: what a suffix shares with the one above it.
            above = np.r_[l_common[1:], 0].astype(np.int32)
            above[-1] = seam(int(l_suffixes[-1]), int(suffixes[-1])) if len(suffixes) else 0
            down.feed(l_suffixes[::-1], above[::-1])
    order, shared = [], []
    for c in present:
        l_suffixes, l_common = l_parts[c]
        suffixes, common = s_parts[c]
        if c == s[-1]:
            suffixes, common = np.array([len(s) - 1]), zero
        order += [l_suffixes, suffixes[::-1]]
        if lcp:
            below = np.r_[0, common[:0:-1]].astype(np.int32) if len(suffixes) else zero
            if len(suffixes) and len(l_suffixes):
                below[0] = seam(int(l_suffixes[-1]), int(suffixes[-1]))
            shared += [l_common, below[: len(suffixes)]]
    return np.concatenate(order), np.concatenate(shared) if lcp else zero


def _names(s: np.ndarray, lms: np.ndarray, is_lms: np.ndarray) -> tuple[np.ndarray, int]:
    """Names, in text order, of LMS substrings that stand sorted: equal substrings have equal names."""
    at = np.flatnonzero(is_lms)
    length = np.zeros(len(s), np.int64)
    length[at] = np.r_[np.diff(at) + 1, 1]
    same = length[lms[1:]] == length[lms[:-1]]
    left, k = np.flatnonzero(same), 0
    while len(left):
        x, y = lms[left] + k, lms[left + 1] + k
        equal = s[x] == s[y]
        same[left[~equal]] = False
        k += 1
        left = left[equal & (k < length[lms[left]])]
    name = np.r_[0, np.cumsum(~same)]
    by_place = np.zeros(len(s), np.int64)
    by_place[lms] = name
    return by_place[at], int(name[-1]) + 1


def _doubling(names: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of a string of names by doubling, and the ranks of its substrings of 1, 2, 4, ... names."""
    rank, k, n, levels = names, 1, len(names), []
    while True:
        levels.append(rank)
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key)
        ranked = key[order]
        new = np.zeros(n, np.int64)
        new[order] = np.r_[0, np.cumsum(ranked[1:] != ranked[:-1])]
        if new[order[-1]] == n - 1:
            return order, levels
        rank, k = new, min(2 * k, n)


def suffix_array(s: np.ndarray, symbols: int, folder: str | None = None) -> np.ndarray:
    """Suffix array of symbols below ``symbols``, of which the last one is the least and occurs once."""
    lms, is_s, run, _ = _sorted_lms(s, symbols, folder)
    return _induce(s, is_s, run, lms, np.zeros(len(lms), np.int32), symbols, 0, False, folder)[0]


def _sorted_lms(s: np.ndarray, symbols: int, folder: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """LMS suffixes in order, the types and runs of all suffixes, and how many symbols each LMS suffix is known to share
    with the one before it (at least)."""
    is_s, run = _types(s)
    is_lms = np.r_[False, is_s[1:] & ~is_s[:-1]]
    at = np.flatnonzero(is_lms)
    none = np.zeros(len(at), np.int64)
    if len(at) < 2:
        return at, is_s, run, none
    first = at[np.argsort(s[at], kind="stable")]
    order, _ = _induce(s, is_s, run, first, np.zeros(len(at), np.int32), symbols, 0, False, folder)
    names, n = _names(s, order[is_lms[order]], is_lms)
    if n == len(at):
        return at[np.argsort(names)], is_s, run, none
    if n <= MOST_BUCKETS:
        return at[suffix_array(names.astype(np.uint16), n, folder)], is_s, run, none
    order, levels = _doubling(names)
    # Names that neighbours share, by their ranks from long substrings to short ones.
    x, y = order[:-1].copy(), order[1:].copy()
    for k in range(len(levels) - 1, -1, -1):
        fits = np.maximum(x, y) + (1 << k) <= len(at) - 1
        same = np.flatnonzero(fits)
        same = same[levels[k][x[same]] == levels[k][y[same]]]
        x[same] += 1 << k
        y[same] += 1 << k
    none[1:] = at[x] - at[order[:-1]]
    return at[order], is_s, run, none


def common_prefixes(raw: np.ndarray, a: np.ndarray, b: np.ndarray, known: np.ndarray, cap: int) -> np.ndarray:
    """Lengths, up to ``cap``, of the common prefixes of the bytes from a[i] and from b[i], of which known[i] are known
    to be equal, eight bytes at a time."""
    padded = np.r_[raw, np.zeros(cap + 16, np.uint8)]
    words = np.ndarray((len(padded) - 7,), "<u8", padded.tobytes(), strides=(1,))
    out, done = np.full(len(a), cap, np.int32), known.copy()
    left = np.flatnonzero(done < cap)
    while len(left):
        x = words[a[left] + done[left]] ^ words[b[left] + done[left]]
        off = np.flatnonzero(x)
        low = x[off] & (~x[off] + np.uint64(1))
        out[left[off]] = np.minimum(cap, done[left[off]] + np.log2(low.astype(np.float64)).astype(np.int64) // 8)
        left = left[x == 0]
        done[left] += 8
        left = left[done[left] < cap]
    return out


def sort_texts(texts: list[bytes], cap: int, folder: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All suffixes of the texts in order: (suffix, common prefix with the one before it up to ``cap`` and to the texts'
    ends, bytes left to the text's end). Suffixes count through the texts, each with one place more for its end."""
    raw = np.frombuffer(b"\0".join([*texts, b"\0"]), np.uint8)  # a place behind each text, and one behind them all
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    s = raw.astype(np.uint16) + np.uint16(2)
    s[ends] = 1
    s[-1] = 0
    left = np.append(np.repeat(ends, np.diff(np.r_[-1, ends])), len(s) - 1) - np.arange(len(s))
    lms, is_s, run, known = _sorted_lms(s, 258, folder)
    common = np.zeros(len(lms), np.int32)
    if len(lms) > 1:
        common[1:] = np.minimum(common_prefixes(raw, lms[:-1], lms[1:], known[1:], cap), np.minimum(left[lms[:-1]], left[lms[1:]]))
    order, shared = _induce(s, is_s, run, lms, common, 258, cap, True, folder)
    return order, shared, left
