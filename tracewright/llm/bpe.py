"""BPE encoding and decoding by speculation and verification.

Greedy longest match proposes a segmentation of each distinct word; a word's
proposal is its BPE encoding exactly when every adjacent token pair is
*compatible*, meaning BPE run on the two tokens' joined text gives back those
two tokens. Compatibility needs only the merge order: play the merges back from
the last to the first along the right spine of the left token and the left spine
of the right one, and see whether a merge across the border would have come
before the merge that consumed either neighbour. Both steps run on NumPy arrays
over all distinct words of a batch at once; only words with an incompatible
pair are merged exactly, again array-wise.

Texts are cut into independent chunks at single spaces (byte-level files) or at
any white space (files that drop it), and chunks are looked up in a bounded
cache, so that each distinct word is segmented once per worker. Texts with code
points on which regular-expression engines may differ are cut by the library's
own normaliser and pre-tokenizer instead.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of a worker's chunk and piece caches, beside those of the batch in hand. A full one starts anew.
CACHE_ENTRIES = 400_000
#: Words with more symbols than this go straight to heap-based merging.
LONG_WORD = 256
#: Texts cut and looked up together.
TEXTS_AT_ONCE = 1024

# The pre-tokenization patterns that the two public files name.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Outside of these code points the library cuts the text itself.
UNSAFE = re.compile("[^\t\n\r\x20-\x7e\xa1-įı-ſ‐-‧‰-⁞₠-₿]")
#: White space beside a space: byte-level pieces then span chunk borders.
SPACE_RUN = re.compile(r" \s|\s | \Z|\0")


def byte_alphabet() -> dict[int, str]:
    """Printable Latin-1 bytes stand for themselves, the others for 256, 257, ..."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in shown else next(rest)) for b in range(256)}


class IntTable:
    """Open-addressing map from non-negative int64 keys to int32 values, read array-wise."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(4 * len(keys) + 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, -1, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] == -1
            _, first = np.unique(slot, return_index=True)
            put = np.zeros(len(left), bool)
            put[first] = True
            put &= free
            self.keys[slot[put]], self.values[slot[put]] = keys[left[put]], values[left[put]]
            left, slot = left[~put], (slot[~put] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], -1)
        left = np.flatnonzero((there != keys) & (there != -1))
        while len(left):
            slot_left = (slot[left] + 1) & self.mask
            slot[left] = slot_left
            there = self.keys[slot_left]
            hit = there == keys[left]
            out[left[hit]] = self.values[slot_left[hit]]
            left = left[~hit & (there != -1)]
        return out


class Vocabulary:
    """Decoder of one tokenizer file: the bytes of each token, without the tables of an encoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.path = path
        self.read(spec)

    def read(self, spec: dict) -> dict[int, list[int] | None]:
        """Takes over the vocabulary; returns the symbols of each token, None where it is not spelled in bytes."""
        vocab = spec["model"]["vocab"]
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.byte_of = byte_of = {c: b for b, c in byte_alphabet().items()}
        self.size = max([*vocab.values(), *self.special.values()]) + 1

        def symbols(token: str) -> list[int] | None:
            last = bool(self.suffix) and token.endswith(self.suffix)
            body = token[: -len(self.suffix)] if last else token
            out = [byte_of[c] for c in body if c in byte_of]
            if len(out) != len(body) or not out:
                return None
            return out[:-1] + [out[-1] + 256] if last else out

        spelled = {i: symbols(token) for token, i in vocab.items()}
        self.token_bytes = [b""] * self.size
        for token, i in vocab.items():
            s = spelled[i]
            self.token_bytes[i] = token.encode() if s is None else bytes(x & 255 for x in s) + (b" " if self.suffix and s[-1] > 255 else b"")
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        return spelled

    def decode(self, ids: bytes) -> bytes:
        """Text of little-endian uint32 ids in UTF-8, as decode(ids, skip_special_tokens=False)."""
        raw = b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()


class Codec(Vocabulary):
    """Encoder and decoder of one tokenizer file. Results equal the library's
    ``encode(text, add_special_tokens=False).ids`` with truncation and padding off."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.path, self._library = path, None
        spelled, model = self.read(spec), spec["model"]
        self.words_only = spec.get("normalizer") is not None
        if model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError(f"{path} is not a plain BPE file")
        vocab, merges = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.special_cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

        self.rank = np.full(self.size, -1, np.int64)
        self.left, self.right = np.full(self.size, -1, np.int64), np.full(self.size, -1, np.int64)
        pair_keys, pair_ranks = [], []
        self.by_rank = np.full(len(merges), -1, np.int64)
        for r, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            pair_keys.append(x * self.size + y)
            pair_ranks.append(r)
            self.by_rank[r] = z
            if self.rank[z] < 0:
                self.rank[z], self.left[z], self.right[z] = r, x, y
        self.pairs = IntTable(np.array(pair_keys, np.int64), np.array(pair_ranks, np.int32))
        self.pair_rank = dict(zip(pair_keys, pair_ranks))

        self.base = np.full(512, -1, np.int64)
        for i, s in spelled.items():
            if s is not None and len(s) == 1:
                self.base[s[0]] = i
        if (self.base[: 512 if self.suffix else 256] < 0).any():
            raise ValueError(f"{path} lacks single-byte tokens")
        # A token may be proposed only if BPE on its own text gives it back.
        own = np.ones(self.size, bool)
        made = np.flatnonzero(self.rank >= 0)
        made = made[np.argsort(self.rank[made], kind="stable")]
        fits = self.compatible(self.left[made], self.right[made], self.rank[made])
        for z, ok, x, y in zip(made.tolist(), fits.tolist(), self.left[made].tolist(), self.right[made].tolist()):
            own[z] = ok and own[x] and own[y]
        child: dict[int, int] = {}
        ends = [-1]
        own = own.tolist()
        for i, s in spelled.items():
            if s is None or not own[i]:
                continue
            state = 0
            for x in s:
                key = state * 512 + x
                state = child.get(key, 0)
                if not state:
                    state = child[key] = len(ends)
                    ends.append(-1)
            ends[state] = i
        self.child = IntTable(np.fromiter(child, np.int64, len(child)), np.fromiter(child.values(), np.int32, len(child)))
        self.ends = np.array(ends, np.int64)
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[bytes, bytes] = {}
        import regex

        self.cut = regex.compile(WORD_PATTERN if self.words_only else BYTE_PATTERN)
        self.n_words = self.n_failed = 0

    # -- verification -----------------------------------------------------

    def compatible(self, x: np.ndarray, y: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether BPE leaves the border between tokens x[i] and y[i] alone (before merge limit[i])."""
        good = np.ones(len(x), bool)
        at, x, y = np.arange(len(x)), x.copy(), y.copy()
        limit = np.full(len(x), np.iinfo(np.int64).max) if limit is None else limit.copy()
        while len(at):
            across = self.pairs.get(x * self.size + y)
            bad = (across >= 0) & (across < limit)
            good[at[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            # The later-made neighbour is taken apart; of equals the right one, as merges run from the left.
            of_x = rx > ry
            going = ~bad & (np.maximum(rx, ry) >= 0)
            limit = np.where(of_x, rx, ry + 1)
            x, y = np.where(of_x, self.right[x], x), np.where(of_x, y, self.left[y])
            at, x, y, limit = at[going], x[going], y[going], limit[going]
        return good

    # -- segmentation -----------------------------------------------------

    def _flat(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size)
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        if self.suffix:
            flat[end - 1] += 256
        return flat, end - size, end

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of all words at once: (token ids, word numbers), in word order."""
        flat, pos, end = self._flat(words)
        flat = np.append(flat, 0)
        n = len(words)
        word, state = np.arange(n), np.zeros(n, np.int64)
        best, best_pos = np.full(n, -1, np.int64), pos.copy()
        ids, owners = [], []
        while len(word):
            inside = pos < end
            nxt = np.where(inside, self.child.get(state * 512 + flat[np.where(inside, pos, len(flat) - 1)]), -1)
            on = nxt >= 0
            pos = np.where(on, pos + 1, best_pos)
            token = np.where(on, self.ends[nxt], -1)
            off = ~on
            if off.any():
                ids.append(best[off])
                owners.append(word[off])
            best = np.where(on, np.where(token >= 0, token, best), -1)
            best_pos = np.where(on & (token < 0), best_pos, pos)
            state = np.where(on, nxt, 0)
            live = on | (pos < end)
            if not live.all():
                word, state, pos, end, best, best_pos = (a[live] for a in (word, state, pos, end, best, best_pos))
        ids, owners = np.concatenate(ids), np.concatenate(owners)
        order = np.argsort(owners, kind="stable")
        return ids[order], owners[order]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Exact BPE of all words at once, a merge per word and round."""
        flat, start, end = self._flat(words)
        ids, owner = self.base[flat], np.repeat(np.arange(len(words)), end - start)
        done_ids, done_owner = [], []
        none = len(self.by_rank)
        while len(ids):
            rank = np.full(len(ids), none, np.int64)
            got = self.pairs.get(ids[:-1] * self.size + ids[1:])
            rank[:-1] = np.where((got >= 0) & (owner[:-1] == owner[1:]), got, none)
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            size = np.diff(np.r_[first, len(ids)])
            least = np.repeat(np.minimum.reduceat(rank, first), size)
            over = least == none
            if over.any():
                done_ids.append(ids[over])
                done_owner.append(owner[over])
                ids, owner, rank, least = ids[~over], owner[~over], rank[~over], least[~over]
            if not len(ids):
                break
            at = np.flatnonzero(rank == least)
            at = at[np.unique(owner[at], return_index=True)[1]]  # the leftmost of each word
            ids[at] = self.by_rank[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, owner = ids[keep], owner[keep]
        ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return ids[order], owner[order]

    def merge_long(self, word: bytes) -> list[int]:
        """Exact BPE of one long word with a heap over a linked list: O(n log n)."""
        symbols = list(word)
        if self.suffix:
            symbols[-1] += 256
        ids: list[int] = self.base[symbols].tolist()
        n, rank = len(ids), self.pair_rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank[k], i) for i in range(n - 1) if (k := ids[i] * self.size + ids[i + 1]) in rank]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or rank.get(ids[i] * self.size + ids[j]) != r:
                continue
            ids[i], ids[j] = int(self.by_rank[r]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (got := rank.get(ids[a] * self.size + ids[b])) is not None:
                    heapq.heappush(heap, (got, a))
        return [i for i in ids if i >= 0]

    def segment(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian uint32 bytes."""
        out: list[bytes] = [b""] * len(words)
        short = [i for i, w in enumerate(words) if 0 < len(w) <= LONG_WORD]
        for i, w in enumerate(words):
            if len(w) > LONG_WORD:
                out[i] = np.array(self.merge_long(w), "<u4").tobytes()
        if not short:
            return out
        some = [words[i] for i in short]
        ids, owner = self.propose(some)
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        failed = np.unique(owner[inner[~self.compatible(ids[inner], ids[inner + 1])]])
        self.n_words += len(some)
        self.n_failed += len(failed)
        if len(failed):
            keep = ~np.isin(owner, failed)
            again, at = self.merge([some[i] for i in failed.tolist()])
            ids, owner = np.concatenate([ids[keep], again]), np.concatenate([owner[keep], failed[at]])
            order = np.argsort(owner, kind="stable")
            ids, owner = ids[order], owner[order]
        raw = ids.astype("<u4").tobytes()
        ends = (np.cumsum(np.bincount(owner, minlength=len(some))) * 4).tolist()
        a = 0
        for i, b in zip(short, ends):
            out[i] = raw[a:b]
            a = b
        return out

    # -- texts ------------------------------------------------------------

    @property
    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def _library_pieces(self, part: str) -> list[bytes]:
        tok = self.library
        part = tok.normalizer.normalize_str(part) if tok.normalizer else part
        return [bytes(map(self.byte_of.__getitem__, p)) for p, _ in tok.pre_tokenizer.pre_tokenize_str(part)]

    def _ready(self, text: str) -> str | None:
        """A text with its chunks marked for cutting, or None if it needs cutting piece by piece."""
        if UNSAFE.search(text) or (self.special_cut and "<|" in text):
            return None
        if self.words_only:
            return text.lower()
        return None if SPACE_RUN.search(text) else text.replace(" ", "\0 ")

    def _pieces(self, text: str) -> list[bytes | int]:
        """Pieces of a text in order; an int is a special token's id."""
        parts = self.special_cut.split(text) if self.special_cut and "<|" in text else [text]
        out: list[bytes | int] = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.special[part])
            elif UNSAFE.search(part):
                out += self._library_pieces(part)
            else:
                out += [p.encode() for p in self.cut.findall(part.lower() if self.words_only else part)]
        return out

    def _cut_chunk(self, chunk: str) -> list[bytes]:
        """Pieces of a chunk. Letters, with or without a space before and full stops or commas behind, need no pattern."""
        word = chunk.rstrip(".,")
        if (word[1:] if word[:1] == " " else word).isalpha():
            return [word.encode()] if len(word) == len(chunk) else [word.encode(), chunk[len(word) :].encode()]
        return [p.encode() for p in self.cut.findall(chunk)]

    def _learn(self, wanted: set[bytes]) -> None:
        """Sees to it that the piece cache holds the wanted pieces."""
        new = list(wanted - self.pieces.keys())
        if len(self.pieces) + len(new) > CACHE_ENTRIES:
            self.pieces, new = {}, list(wanted)
        self.pieces.update(zip(new, self.segment(new)))

    def _known(self, units: list[str], rare: list[bytes]) -> list[bytes]:
        """Ids of each of the distinct chunks; the piece cache then also holds the rare pieces."""
        made = list(map(self.chunks.get, units))
        new = [i for i, x in enumerate(made) if x is None]
        cut = [self._cut_chunk(units[i]) for i in new]
        self._learn({p for ps in cut for p in ps}.union(rare))
        piece = self.pieces.__getitem__
        for i, ps in zip(new, cut):
            made[i] = piece(ps[0]) if len(ps) == 1 else b"".join(map(piece, ps))
        if len(self.chunks) + len(new) > CACHE_ENTRIES:
            # What this batch shares with earlier ones is what comes often.
            fresh = set(new)
            self.chunks = {u: x for i, (u, x) in enumerate(zip(units, made)) if i not in fresh}
        self.chunks.update((units[i], made[i]) for i in new)
        return made

    def encode_batch(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of each text as little-endian uint32 bytes; null is read as empty.

        Chunks are cut and made distinct by Arrow; only distinct ones are looked up, and
        ids are laid out for all texts at once."""
        texts = list(texts)
        ready = [self._ready(t) if t else "" for t in texts]
        rare = {i: self._pieces(texts[i]) for i, t in enumerate(ready) if t is None}
        marked = pa.array(["" if t is None else t for t in ready], pa.large_string())
        cut = pc.ascii_split_whitespace(marked) if self.words_only else pc.split_pattern(marked, "\0")
        words = cut.flatten().dictionary_encode()
        ids = self._known(words.dictionary.to_numpy(zero_copy_only=False).tolist(), [p for ps in rare.values() for p in ps if type(p) is bytes])
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, first, at = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size, words.indices.to_numpy()
        n = size[at]
        end = np.r_[0, np.cumsum(n)]
        raw = flat[np.repeat(first[at] - end[:-1], n) + np.arange(end[-1])].tobytes()
        borders = (4 * end[cut.offsets.to_numpy()]).tolist()
        out = [raw[a:b] for a, b in zip(borders, borders[1:])]
        piece = self.pieces.__getitem__
        for i, ps in rare.items():
            out[i] = b"".join([piece(p) if type(p) is bytes else p.to_bytes(4, "little") for p in ps])
        return out


_CODECS: dict[str, Codec] = {}
_VOCABULARIES: dict[str, Vocabulary] = {}


def codec(path: str) -> Codec:
    """The worker's codec of a file; loaded once."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def vocabulary(path: str) -> Vocabulary:
    """The worker's decoder of a file: its codec if one is loaded, else the vocabulary alone."""
    if path in _CODECS:
        return _CODECS[path]
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def blocks(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Runs of texts of bounded length together."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t or "")
        if len(run) >= TEXTS_AT_ONCE or size > 8_000_000:
            yield run
            run, size = [], 0
    if run:
        yield run


def encode_all(c: Codec, texts: list[str | None]) -> Iterator[bytes]:
    for run in blocks(texts):
        # A batch makes many short-lived lists beside large caches; collections in between would only walk the caches.
        collecting = gc.isenabled()
        gc.disable()
        try:
            made = c.encode_batch(run)
        finally:
            if collecting:
                gc.enable()
        yield from made


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
