"""Byte-level BPE without a regex engine.

Boundaries: each code point has a class (one table), each class is a function on the states of a small
automaton, and these functions form a finite monoid. Composition is associative, so the state after every
character of a whole batch of texts comes from a blocked prefix scan over function numbers; boundaries are then
read off neighbouring states. Slices between boundaries go through a cache of pair merges.

Null and empty texts encode to no ids; bytes that are no UTF-8 count as U+FFFD. A text is encoded whole, whatever
its length; a slice of n bytes merges in O(n log n). Rows are independent: repeated rows give repeated results, an
empty table an empty one, and only the named columns are read, so further columns of any name do no harm."""

from __future__ import annotations

import base64
import heapq
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewheel.llm._shared import beside, column_list, in_arrow, mix64, slices_of, text_bytes

#: A rank file is sent to every executor; larger ones are refused.
MOST_RANK_BYTES = 64_000_000
#: Merged slices that a worker remembers, in each of two generations.
REMEMBERED = 60_000
#: Characters of text scanned at once; longer texts are cut where white space follows, which ends a token whatever stands around it.
SCAN_CHARS = 1 << 18
#: Bytes of texts whose ids are held at once.
SLICE = 1_000_000
#: Bytes of a slice that still merges in a grid, and rows of a grid.
WIDEST, SIDE_BY_SIDE = 64, 8192
#: The rank of a pair that doesn't merge.
FAR = np.int64(1 << 60)

# Classes of characters. ONE ends a contraction after an apostrophe, RV needs an e, ELL another l.
LETTER, NUMBER, OTHER, SPACE, WHITE, QUOTE, ONE, RV, ELL, EE = range(10)
# States: what the token that holds the last character is.
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, AFTER_WHITE, QUOTED, QUOTED_RV, QUOTED_ELL, CONTRACTED = range(10)
#: The code points with the property White_Space.
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
WHITE_CLASS = "".join(map(chr, WHITE_SPACE))
#: A character that isn't white before one that is: no token goes on from the one to the other.
BREAK = re.compile(f"[^{WHITE_CLASS}](?=[{WHITE_CLASS}])")


def step(state: int, kind: int) -> int:
    """The automaton's next state."""
    if kind == NUMBER:
        return IN_NUMBERS
    if kind == SPACE:
        return AFTER_SPACE
    if kind == WHITE:
        return AFTER_WHITE
    if kind == OTHER:
        return IN_OTHERS
    if kind == QUOTE:  # only a quote that begins a token can begin a contraction
        return IN_OTHERS if state in (IN_OTHERS, QUOTED, AFTER_SPACE) else QUOTED
    if state == QUOTED:
        return {ONE: CONTRACTED, RV: QUOTED_RV, ELL: QUOTED_ELL}.get(kind, IN_LETTERS)
    if (state, kind) in ((QUOTED_RV, EE), (QUOTED_ELL, ELL)):
        return CONTRACTED
    return IN_LETTERS


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for i in range(sys.maxunicode + 1):
        major = unicodedata.category(chr(i))[0]
        if major == "L":
            out[i] = LETTER
        elif major == "N":
            out[i] = NUMBER
    out[WHITE_SPACE] = WHITE
    out[0x20] = SPACE
    out[ord("'")] = QUOTE
    for letters, kind in (("stmd", ONE), ("rv", RV), ("l", ELL), ("e", EE)):
        out[[ord(x) for x in letters]] = kind
    return out


@lru_cache(1)
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """compose[f * n + g] (f, then g), apply[f * states + s], the number of each class's function and of each
    class's function after a reset to START: (compose, apply, numbers of both, n)."""
    states = range(10)
    letters = [tuple(step(s, k) for s in states) for k in range(10)]
    resets = [(f[START],) * 10 for f in letters]
    known = dict.fromkeys([*letters, *resets])
    queue = list(known)
    while queue:
        f = queue.pop()
        for g in letters + resets:
            h = tuple(g[s] for s in f)
            if h not in known:
                known[h] = None
                queue.append(h)
    number = {f: i for i, f in enumerate(known)}
    n = len(number)
    compose = np.array([[number[tuple(g[s] for s in f)] for g in number] for f in number], np.int32)
    apply = np.array(list(number), np.uint8)
    return compose.ravel(), apply.ravel(), np.array([[number[f] for f in letters], [number[f] for f in resets]], np.int32), n


def scan_states(kinds: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The state after each character; `first` are the positions at which texts begin."""
    compose, apply, numbers, n = monoid()
    f = numbers[0][kinds]
    f[first] = numbers[1][kinds[first]]
    size = len(f)
    width = max(1, int(size**0.5))
    blocks = -(-size // width)
    grid = np.zeros(blocks * width, np.int32)
    grid[:size] = f
    grid = np.ascontiguousarray(grid.reshape(blocks, width).T)
    for j in range(1, width):  # a prefix scan inside all blocks at once
        grid[j] = compose[grid[j - 1] * n + grid[j]]
    total, hop = grid[-1].copy(), 1
    while hop < blocks:  # a doubling scan over the blocks' totals
        total[hop:] = compose[total[:-hop] * n + total[hop:]]
        hop *= 2
    before = np.full(blocks, START, np.int32)
    before[1:] = apply[total[:-1] * 10 + START]
    return apply[grid * 10 + before].T.ravel()[:size]


@lru_cache(1)
def starts_table() -> np.ndarray:
    """Whether a token starts between two states, where no look ahead is needed."""
    t = np.ones((10, 10), bool)
    for before, now in (
        (IN_LETTERS, IN_LETTERS), (AFTER_SPACE, IN_LETTERS), (QUOTED_RV, IN_LETTERS), (QUOTED_ELL, IN_LETTERS),
        (IN_NUMBERS, IN_NUMBERS), (AFTER_SPACE, IN_NUMBERS),
        (IN_OTHERS, IN_OTHERS), (QUOTED, IN_OTHERS), (AFTER_SPACE, IN_OTHERS),
        (QUOTED, CONTRACTED), (QUOTED_RV, CONTRACTED), (QUOTED_ELL, CONTRACTED),
        (AFTER_SPACE, AFTER_SPACE), (AFTER_SPACE, AFTER_WHITE), (AFTER_WHITE, AFTER_SPACE), (AFTER_WHITE, AFTER_WHITE),
    ):
        t[before, now] = False
    return t.ravel()


@lru_cache(1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    base = 0x9E3779B97F4A7C15
    both = np.ones((2, n), np.uint64)
    both[:, 1:] = np.array([[base], [pow(base, -1, 1 << 64)]], np.uint64)
    return tuple(np.multiply.accumulate(both, axis=1))


def distinct_slices(code: np.ndarray, at: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One slice of each kind, and the number of its kind for every slice. Rolling hashes find the kinds; all
    code points are compared afterwards, and slices that differ in spite of equal hashes stay apart."""
    up, down = powers(max(SCAN_CHARS, 1 << (len(code) - 1).bit_length()))
    rolled = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(mix64(code.astype(np.uint64) + np.uint64(1)) * up[: len(code)], out=rolled[1:])
    _, distinct, which = np.unique(mix64((rolled[stop] - rolled[at]) * down[at]) + (stop - at).astype(np.uint64), return_index=True, return_inverse=True)
    size = stop - at
    model = distinct[which]
    same = size == size[model]
    shift = np.repeat(np.where(same, at[model] - at, 0), size)
    differs = code != code[np.arange(len(code)) + shift]
    if not same.all() or differs.any():
        same &= np.add.reduceat(differs, at) == 0
        odd = np.flatnonzero(~same)
        which[odd] = len(distinct) + np.arange(len(odd))
        distinct = np.append(distinct, odd)
    return distinct, which


def boundaries(code: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The positions at which slices start in code points (of several texts, one after another, beginning at `first`)."""
    kinds = classes()[code]
    state = scan_states(kinds, first)
    opens = np.zeros(len(state) + 1, bool)
    opens[first] = True
    following = np.append(state[1:], START)
    following[first[1:] - 1] = START  # a text's last character has no successor
    previous = np.concatenate([[START], state[:-1]]).astype(np.intp)
    begins = starts_table()[previous * 10 + state]
    white = (state == AFTER_SPACE) | (state == AFTER_WHITE)
    begins |= white & (following != AFTER_SPACE) & (following != AFTER_WHITE) & (following != START)
    pending = (state == QUOTED_RV) | (state == QUOTED_ELL)
    begins &= ~(pending & (following == CONTRACTED))
    opens[:-1] |= begins
    return np.flatnonzero(opens[:-1])


class Vocabulary:
    """Ranks of a file with a base64 token and its rank on each line."""

    def __init__(self, data: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        size = max(self.ranks.values(), default=-1) + 1
        lengths = np.zeros(size, np.int64)
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
            lengths[rank] = len(token)
        self.lengths = lengths
        self.offsets = np.cumsum(lengths) - lengths
        self.joined = np.frombuffer(b"".join(tokens), np.uint8)
        self.packed = {t: r.to_bytes(4, "little") for t, r in self.ranks.items()}
        self.single = np.array([self.ranks.get(bytes([i]), 0) for i in range(256)], np.int64)
        pairs = sorted((self.ranks[t[:k]] << 32 | self.ranks[t[k:]], r) for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks)
        self.pair_keys = np.array([k for k, _ in pairs] or [-1], np.int64)
        self.pair_ranks = np.array([r for _, r in pairs] or [FAR], np.int64)
        self.younger: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of each slice as little-endian 32-bit values; slices of like length merge side by side."""
        out, byte_forms, by_width = {}, {}, {}
        for p in pieces:
            b = p.encode()
            if (whole := self.packed.get(b)) is not None:
                out[p] = whole
            elif len(b) > WIDEST:
                out[p] = b"".join([self.packed[x] for x in self._merge_long(b)])
            else:
                byte_forms[p] = b
                by_width.setdefault(1 << (len(b) - 1).bit_length(), []).append(p)
        for width, group in by_width.items():
            for i in range(0, len(group), SIDE_BY_SIDE):
                part = group[i : i + SIDE_BY_SIDE]
                out.update(zip(part, self._merge_grid([byte_forms[p] for p in part], width), strict=True))
        return out

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, FAR where they don't merge; negative ids are none."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (a >= 0) & (b >= 0), self.pair_ranks[at], FAR)

    def _merge_grid(self, pieces: list[bytes], width: int) -> list[bytes]:
        """In each round every row merges its pair of lowest rank, the leftmost among equals; column 0 and the
        last one are borders without an id, and links lead over what has been merged away."""
        m, w = len(pieces), width + 2
        raw = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8).reshape(m, width)
        sizes = np.array([len(p) for p in pieces])
        ids = np.full((m, w), -1, np.int32)
        ids[:, 1:-1] = np.where(np.arange(width) < sizes[:, None], self.single[raw], -1)
        ranks = np.full((m, w), FAR)
        ranks[:, :-1] = self.pair_rank(ids[:, :-1], ids[:, 1:])
        after = np.tile(np.minimum(np.arange(w) + 1, w - 1), m)
        before = np.tile(np.maximum(np.arange(w) - 1, 0), m)
        ids, grid, ranks = ids.ravel(), ranks, ranks.ravel()
        own = np.arange(m)
        while len(own):
            j = grid[own].argmin(1)
            low = ranks[own * w + j]
            if (over := low == FAR).any():
                own, j, low = own[~over], j[~over], low[~over]
            base = own * w
            at = base + j
            gone = base + after[at]
            beyond = base + after[gone]
            ids[at], ids[gone], ranks[gone] = low, -1, FAR
            after[at] = beyond - base
            before[beyond] = j
            ranks[at] = self.pair_rank(ids[at], ids[beyond])
            left = base + before[at]
            ranks[left] = self.pair_rank(ids[left], ids[at])
        kept = ids.reshape(m, w) >= 0
        flat = ids[kept.ravel()].astype("<u4").tobytes()
        stop = (np.cumsum(kept.sum(1)) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *stop], stop, strict=False)]

    def _merge_long(self, piece: bytes) -> list[bytes]:
        """Lowest rank first, leftmost among equals, by a heap of pairs over a linked list."""
        n = len(piece)
        end = list(range(1, n + 1))  # of the part that starts here; 0 once it is merged into another
        before = list(range(-1, n - 1))
        get, heap = self.ranks.get, []
        for i in range(n - 1):
            if (r := get(piece[i : i + 2])) is not None:
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if not middle or middle >= n or middle >= stop or end[middle] != stop:
                continue
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (j := before[i]) >= 0 and (r := get(piece[j:stop])) is not None:
                heapq.heappush(heap, (r, j, stop))
        parts, i = [], 0
        while i < n:
            parts.append(piece[i : end[i]])
            i = end[i]
        return parts

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Of each text: its ids, and the byte at which each token ends, as little-endian 32-bit values."""
        ids, ends = [b""] * len(texts), [b""] * len(texts)
        group: list[int] = []
        held = 0
        for i, text in enumerate(texts):
            if len(text) > SCAN_CHARS:
                ids[i], ends[i] = self._encode_long(text)
            elif text:
                if held + len(text) > SCAN_CHARS and group:
                    self._encode_group(texts, group, ids, ends)
                    group, held = [], 0
                group.append(i)
                held += len(text)
        if group:
            self._encode_group(texts, group, ids, ends)
        return ids, ends

    def _encode_long(self, text: str) -> tuple[bytes, bytes]:
        """encode() of one text in parts of about SCAN_CHARS characters."""
        at = [0]
        for m in BREAK.finditer(text):
            if m.end() - at[-1] >= SCAN_CHARS:
                at.append(m.end())
        parts = [text[a:b] for a, b in zip(at, [*at[1:], len(text)], strict=True)]
        ids, ends, base = [], [], 0
        for k in range(len(parts)):
            own_ids, own_ends = [b""] * len(parts), [b""] * len(parts)
            self._encode_group(parts, [k], own_ids, own_ends)
            stop = np.frombuffer(own_ends[k], "<u4") + np.uint32(base)
            base = int(stop[-1])
            ids.append(own_ids[k])
            ends.append(stop.astype("<u4").tobytes())
        return b"".join(ids), b"".join(ends)

    def _encode_group(self, texts: list[str], group: list[int], ids: list[bytes], ends: list[bytes]) -> None:
        text = "".join([texts[i] for i in group])
        sizes = np.array([len(texts[i]) for i in group])
        first = np.cumsum(sizes) - sizes
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        at = boundaries(code, first)
        stop = np.append(at[1:], len(code))
        distinct, which = distinct_slices(code, at, stop)
        found = self.remembered([text[a:b] for a, b in zip(at[distinct].tolist(), stop[distinct].tolist(), strict=True)])
        counts = np.array([len(x) for x in found]) // 4
        pool, pool_at = np.frombuffer(b"".join(found), "<u4"), np.cumsum(counts) - counts
        own = counts[which]
        run = np.cumsum(own)
        flat = pool[np.repeat(pool_at[which] - (run - own), own) + np.arange(run[-1])]
        edge = np.append(run[np.searchsorted(at, first[1:]) - 1], run[-1])
        length = np.cumsum(self.lengths[flat])
        begin = 0
        for i, end in zip(group, edge.tolist(), strict=True):
            ids[i] = flat[begin:end].tobytes()
            ends[i] = (length[begin:end] - (length[begin - 1] if begin else 0)).astype("<u4").tobytes()
            begin = end

    def remembered(self, pieces: list[str]) -> list[bytes]:
        """The ids of different slices, from the cache where it has them; when the younger half is full, the older is forgotten."""
        ids = list(map(self.younger.get, pieces))
        missing = [p for p, x in zip(pieces, ids, strict=True) if x is None]
        if missing:
            found = {p: x for p in missing if (x := self.older.get(p)) is not None}
            found |= self.merge([p for p in missing if p not in found])
            ids = [found[p] if x is None else x for p, x in zip(pieces, ids, strict=True)]
            if len(self.younger) + len(found) > REMEMBERED:
                self.older, self.younger = self.younger, {}
            self.younger.update((p, x) for p, x in found.items() if len(p) <= WIDEST)
        return ids

    def decode(self, ids: bytes, ends: bytes) -> bytes:
        """The bytes of a text, gathered into place by the tokens' ends."""
        at, stop = np.frombuffer(ids, "<u4"), np.frombuffer(ends, "<u4").astype(np.int64)
        if not len(at):
            return b""
        sizes = np.diff(stop, prepend=0)
        if (sizes != self.lengths[at]).any():
            raise ValueError("ids and offsets don't belong together")
        return self.joined[np.repeat(self.offsets[at] - (stop - sizes), sizes) + np.arange(stop[-1])].tobytes()


@lru_cache(2)
def vocabulary(data: bytes) -> Vocabulary:
    """One vocabulary a worker process, however many tasks it runs."""
    return Vocabulary(data)


def read_ranks(path: str) -> bytes:
    """A rank file as bytes, read where the query is planned."""
    with open(path, "rb") as f:
        data = f.read(MOST_RANK_BYTES + 1)
    if len(data) > MOST_RANK_BYTES:
        raise ValueError(f"{path} has over {MOST_RANK_BYTES} bytes")
    return data


def encode(df: DataFrame, ranks_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), decoded: bool = False) -> DataFrame:
    """`keep`, and of each row's text: n_tokens, ids and ends (each token's end in bytes), both as little-endian
    32-bit values; with `decoded` also the bytes that the ids decode to, made in the same pass."""
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(ranks.value)
        for batch in batches:
            for part in slices_of(batch, len(keep), SLICE):
                ids, ends = v.encode([x.decode(errors="replace") for x in text_bytes(part.column(len(keep)))])
                columns = [*part.columns[:-1], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(ends, pa.binary())]
                if decoded:
                    columns.append(pa.array([v.decode(a, b) for a, b in zip(ids, ends, strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_tokens", "ids", "ends", *["decoded"] * decoded])

    return df.select(*keep, beside(keep, text)).transform(in_arrow, run, f"{column_list(df, keep)}, n_tokens bigint, ids binary, ends binary" + ", decoded binary" * decoded)


def decode(df: DataFrame, ranks_path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, and decoded: the bytes of each row's ids and ends, as encode() gives them; null ids give no bytes."""
    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(ranks.value)
        for batch in batches:
            for part in slices_of(batch, len(keep)):
                ids, ends = (text_bytes(part.column(len(keep) + k)) for k in (0, 1))
                decoded = pa.array([v.decode(a, b) for a, b in zip(ids, ends, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], decoded], names=[*keep, "decoded"])

    return df.select(*keep, "ids", "ends").transform(in_arrow, run, f"{column_list(df, keep)}, decoded binary")
