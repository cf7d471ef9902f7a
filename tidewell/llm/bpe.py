"""Byte-level BPE: encoding with retained offsets, and decoding.

Text is cut into pieces without a regular expression: code points are mapped to a few classes by one table, and the piece
boundaries are found by an automaton whose per-character transition functions are composed by an associative scan, so that
numpy works on all blocks of a batch at once. The slices are looked up in a cache; unknown ones go through the pair merges
together, as one matrix per length.

Null and empty texts give no tokens. Bytes that aren't UTF-8 are read as U+FFFD. Repeated rows give repeated results; other
columns are ignored. Nothing is shuffled, so the size of a task is the size of its input.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import chunks, decoded, documents, slices

L, N, O, WS, SP, AP, END = range(7)
#: Characters that \s stands for in the pattern (fixed values, Unicode White_Space).
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Symbols of the automaton: letter, number, other, white space inside a run, the blank before a word, the last other white
#: space of a run, an apostrophe before a one- or a two-letter ending, the end of a text, padding.
LETTER, NUMBER, OTHER, INSIDE, BLANK, LAST, ONE, TWO, STOP, PAD = range(10)
#: States: in letters, in numbers, in others, in white space, after a joining blank, two and one letters of an ending to
#: come, at a fresh start.
IN_L, IN_N, IN_O, IN_W, JOIN, LEFT2, LEFT1, FRESH = range(8)
#: Letters and numbers of Unicode 16, which the tokenizer libraries know and Python 3.13 doesn't (fixed values).
NEW_LETTERS = [
    (0x1C89, 0x1C8B), (0xA7CB, 0xA7CE), (0xA7DA, 0xA7DD), (0x105C0, 0x105F4), (0x10D4A, 0x10D66), (0x10D6F, 0x10D86), (0x10EC2, 0x10EC5),
    (0x11380, 0x1138A), (0x1138B, 0x1138C), (0x1138E, 0x1138F), (0x11390, 0x113B6), (0x113B7, 0x113B8), (0x113D1, 0x113D2), (0x113D3, 0x113D4),
    (0x11BC0, 0x11BE1), (0x13460, 0x143FB), (0x16100, 0x1611E), (0x16D40, 0x16D6D), (0x18CFF, 0x18D00), (0x1E5D0, 0x1E5EE), (0x1E5F0, 0x1E5F1),
]
NEW_NUMBERS = [(0x10D40, 0x10D4A), (0x116D0, 0x116E4), (0x11BF0, 0x11BFA), (0x16130, 0x1613A), (0x16D70, 0x16D7A), (0x1CCF0, 0x1CCFA), (0x1E5F1, 0x1E5FB)]
CHUNK_CHARS = 1 << 19
CACHE_WORDS = 100_000


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a piece starts here), both by symbol * 8 + state."""
    to = {LETTER: IN_L, NUMBER: IN_N, OTHER: IN_O, INSIDE: IN_W, BLANK: JOIN, LAST: FRESH, ONE: LEFT1, TWO: LEFT2, STOP: FRESH}
    goes_on = {LETTER: {IN_L, JOIN}, NUMBER: {IN_N, JOIN}, OTHER: {IN_O, JOIN}, INSIDE: {IN_W}, ONE: {IN_O, JOIN}, TWO: {IN_O, JOIN}}
    step, start = np.zeros(80, np.int64), np.zeros(80, bool)
    for symbol in range(10):
        for state in range(8):
            k = symbol * 8 + state
            if symbol == PAD:
                step[k] = state
            elif symbol == LETTER and state in (LEFT2, LEFT1):
                step[k] = LEFT1 if state == LEFT2 else FRESH
            elif symbol in (ONE, TWO) and state in (IN_O, JOIN):
                step[k] = IN_O
            else:
                step[k], start[k] = to[symbol], state not in goes_on.get(symbol, ())
    return step, start


STEP, START = _automaton()


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point, and END at 0x110000."""
    from unicodedata import category

    table = np.full(0x110001, O, np.uint8)
    kinds = np.array([{"L": L, "N": N}.get(category(chr(c))[0], O) for c in range(0x20000)], np.uint8)
    table[: len(kinds)] = kinds
    table[[c for c in range(0x20000, 0x110000) if category(chr(c))[0] == "L"]] = L
    for value, ranges in ((L, NEW_LETTERS), (N, NEW_NUMBERS)):
        for first, end in ranges:
            table[first:end] = value
    table[WHITE] = WS
    table[0x20], table[0x27], table[0x110000] = SP, AP, END
    return table


def symbols(points: np.ndarray) -> np.ndarray:
    """points: code points of texts, each followed by 0x110000."""
    kind = classes()[points]
    out = np.array([LETTER, NUMBER, OTHER, INSIDE, INSIDE, OTHER, STOP], np.int64)[kind]
    white = (kind == WS) | (kind == SP)
    follows = np.zeros(len(kind), bool)
    follows[:-1] = ~white[1:] & (kind[1:] != END)
    out[follows & (kind == SP)] = BLANK
    out[follows & (kind == WS)] = LAST
    at = np.flatnonzero(kind == AP)
    if len(at):
        a, b = points[np.minimum(at + 1, len(points) - 1)], points[np.minimum(at + 2, len(points) - 1)]
        out[at[np.isin(a, [*map(ord, "stmd")])]] = ONE
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        out[at[two]] = TWO
    return out


def starts(symbol: np.ndarray) -> np.ndarray:
    """Whether a piece (or an end) starts at each place.

    Each block of places is first summed up as a function from the state before it to the state after it; function composition
    is associative, so the blocks' prefixes come from a doubling scan; then all blocks are walked again, side by side.
    """
    n = len(symbol)
    width = 16
    while width < 512 and width * width * 16 < n:
        width *= 2
    blocks = -(-n // width)
    rows = np.full(blocks * width, PAD * 8, np.int64)
    rows[:n] = symbol * 8
    rows = np.ascontiguousarray(rows.reshape(blocks, width).T)
    whole = np.tile(np.arange(8), (blocks, 1))
    for row in rows:
        whole = STEP.take(row[:, None] + whole)
    by = 1
    while by < blocks:
        whole[by:] = np.take_along_axis(whole[by:], whole[:-by].copy(), 1)
        by *= 2
    state = np.full(blocks, FRESH, np.int64)
    state[1:] = whole[:-1, FRESH]
    out = np.empty((width, blocks), bool)
    for k, row in enumerate(rows):
        at = row + state
        out[k] = START.take(at)
        state = STEP.take(at)
    return out.T.reshape(-1)[:n]


class Pairs:
    """(left id, right id) -> merged id, for arrays; an open hash table."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, ids = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None:
                    keys.append(a << 20 | b)
                    ids.append(rank)
        key, value = np.array(keys, np.int64), np.array(ids, np.int64)
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.key, self.value = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int64)
        at, self.probes = self.home(key), 0
        while len(key):
            self.probes += 1
            free = self.key[at] == -1
            self.key[at[free]] = key[free]
            put = self.key[at] == key
            self.value[at[put]] = value[put]
            key, value, at = key[~put], value[~put], (at[~put] + 1) & ((1 << self.bits) - 1)

    def home(self, key):
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """NONE for what isn't a pair; an id of -1 is none."""
        key = (a << 20 | b).ravel()
        at = self.home(key)
        seen = self.key.take(at)
        out = np.where(seen == key, self.value.take(at), NONE)
        left = np.flatnonzero((seen != key) & (seen != -1) & (key >= 0))
        for _ in range(self.probes):
            if not len(left):
                break
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            seen = self.key[at[left]]
            hit = seen == key[left]
            out[left[hit]] = self.value[at[left[hit]]]
            left = left[~hit & (seen != -1)]
        out[key < 0] = NONE
        return out.reshape(a.shape)


NONE = 1 << 40


class Encoder:
    """The merges of one rank file, with a bounded cache of slices."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.token = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.token[rank] = token
        self.length = np.array([len(t) for t in self.token], np.int64)
        self.bytes, self.begin = np.frombuffer(b"".join(self.token), np.uint8), np.cumsum(self.length) - self.length
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs = Pairs(self.ranks)
        self.cache: dict[str, bytes] = {}

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian 32-bit integers; words of like length share a matrix."""
        out: list[bytes] = [b""] * len(words)
        shelves: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            if (rank := self.ranks.get(w)) is not None:
                out[k] = rank.to_bytes(4, "little")
            elif len(w) > 128:
                out[k] = np.array(self.merge_long(w), "<u4").tobytes()
            else:
                shelves.setdefault(len(w) if len(w) <= 24 else -(-len(w) // 16) * 16, []).append(k)
        for width, own in shelves.items():
            for a in range(0, len(own), 16384):
                part = own[a : a + 16384]
                for k, ids in zip(part, self._merge_matrix([words[k] for k in part], width), strict=True):
                    out[k] = ids
        return out

    def _merge_matrix(self, words: list[bytes], width: int) -> list[bytes]:
        """Each round merges the best pair of every word that has one; done words leave the matrix."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(len(words), width)
        columns = np.arange(width)
        ids = np.where(columns < size[:, None], self.byte[raw], -1)
        rank = np.full((len(words), width), NONE, np.int64)
        rank[:, :-1] = np.where(columns[1:] < size[:, None], self.pairs.get(ids[:, :-1], ids[:, 1:]), NONE)
        where, done, done_size = np.arange(len(words)), np.empty((len(words), width), "<u4"), size.copy()
        while True:
            best = rank.argmin(1)
            row = np.arange(len(rank))
            least = rank[row, best]
            if not (go := least < NONE).all():
                done[where[~go]], done_size[where[~go]] = ids[~go], size[~go]
                ids, rank, size, where, best, least = ids[go], rank[go], size[go], where[go], best[go], least[go]
                row = np.arange(len(rank))
            if not len(rank):
                break
            shift = np.flatnonzero((columns[:-1] > best[:, None]).ravel())
            shift += shift // (width - 1)
            for m, fill in ((ids, -1), (rank, NONE)):
                flat = m.reshape(-1)
                flat[shift] = flat[shift + 1]
                m[:, -1] = fill
            ids[row, best] = least
            size -= 1
            right, left = np.minimum(best + 1, width - 1), np.maximum(best - 1, 0)
            pair = self.pairs.get(np.concatenate([ids[row, best], ids[row, left]]), np.concatenate([ids[row, right], ids[row, best]]))
            rank[row, best] = np.where(best + 1 < size, pair[: len(row)], NONE)
            some = best > 0
            rank[row[some], left[some]] = pair[len(row) :][some]
        flat = done.tobytes()
        return [flat[k : k + n] for k, n in zip(range(0, len(flat), 4 * width), (done_size * 4).tolist(), strict=True)]

    def merge_long(self, word: bytes) -> list[int]:
        """One long word by a heap over a linked list: n log n for any text."""
        ids = [int(self.byte[b]) for b in word]
        n = len(ids)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        part = [word[k : k + 1] for k in range(n)]
        heap = [(r, k, 1, 1) for k in range(n - 1) if (r := self.ranks.get(part[k] + part[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k, a, b = heapq.heappop(heap)
            j = after[k] if part[k] else n
            if len(part[k]) != a or j >= n or len(part[j]) != b:
                continue
            part[k], ids[k], part[j] = part[k] + part[j], rank, b""
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
                if (r := self.ranks.get(part[k] + part[after[k]])) is not None:
                    heapq.heappush(heap, (r, k, len(part[k]), len(part[after[k]])))
            if (p := before[k]) >= 0 and (r := self.ranks.get(part[p] + part[k])) is not None:
                heapq.heappush(heap, (r, p, len(part[p]), len(part[k])))
        return [i for i, p in zip(ids, part, strict=True) if p]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for a, b in chunks([len(t) for t in texts], CHUNK_CHARS):
            out += self._encode(texts[a:b])
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        sizes = np.array([len(t) + 1 for t in texts])
        points = np.full(int(sizes.sum()), 0x110000, np.uint32)
        ends = np.cumsum(sizes)
        joined = "".join(texts)
        mask = np.ones(len(points), bool)
        mask[ends - 1] = False
        points[mask] = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        at = np.flatnonzero(starts(symbols(points)))
        stop = np.searchsorted(at, ends - 1)  # an end always starts a piece of its own
        own = np.repeat(np.arange(len(texts)), np.diff(stop, prepend=-1))
        first = (at - own).tolist()
        pieces, k = [], 0
        for e in stop.tolist():
            cut = first[k : e + 1]
            pieces += map(joined.__getitem__, map(slice, cut, cut[1:]))
            k = e + 1
        found = list(map(self.cache.get, pieces))
        if None in found:
            if len(self.cache) > CACHE_WORDS:
                self.cache.clear()
            miss = [k for k, x in enumerate(found) if x is None]
            new = list(dict.fromkeys(pieces[k] for k in miss))
            got = dict(zip(new, self.merge_many([w.encode() for w in new]), strict=True))
            for k in miss:
                found[k] = got[pieces[k]]
            self.cache.update((w, ids) for w, ids in got.items() if len(w) <= 64)
        out, k, gone = [], 0, 0
        for e in stop.tolist():
            count = e - gone
            out.append(b"".join(found[k : k + count]))
            k, gone = k + count, e + 1
        return out

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Where each token begins in the text's bytes."""
        size = self.length[ids]
        return (np.cumsum(size) - size).astype("<u4")

    def decode(self, ids: np.ndarray, offsets: np.ndarray | None = None) -> bytes:
        """Each token's bytes at its offset; offsets as offsets() gives them."""
        size = self.length[ids]
        at = (np.cumsum(size) - size if offsets is None else offsets.astype(np.int64)) if len(ids) else size
        return self.bytes[np.repeat(self.begin[ids] - at, size) + np.arange(int(size.sum()))].tobytes()


@lru_cache(4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(df: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text", arrays: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids and offsets of every text.

    ids are the tokens' ranks, offsets the tokens' first bytes in the text; both are array<long>, or with arrays=False the
    little-endian unsigned 32-bit integers as binary. ranks is the path of a rank file that every executor has.
    """
    kind = df.schema[id_col].dataType.simpleString()
    many = "array<bigint>" if arrays else "binary"

    def run(batches):
        import pyarrow as pa

        coder = encoder(ranks)
        for batch in batches:
            for part, raw in slices(batch, 1):
                coded = coder.encode([decoded(t) for t in raw])
                ids = [np.frombuffer(x, "<u4") for x in coded]
                if arrays:
                    own = [pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())), pa.array([coder.offsets(x).astype(np.int64) for x in ids], pa.list_(pa.int64()))]
                else:
                    own = [pa.array(coded, pa.binary()), pa.array([coder.offsets(x).tobytes() for x in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in ids], pa.int64()), *own], ["doc_id", "n_tokens", "ids", "offsets"])

    return df.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids {many}, offsets {many}")


def numbers(x) -> np.ndarray:
    """ids or offsets of either kind."""
    return (np.frombuffer(x, "<u4") if isinstance(x, bytes) else np.array(x or [])).astype(np.int64)


def decode(df: DataFrame, ranks: str) -> DataFrame:
    """What encode() returned, with ids and offsets as either kind, and the column decoded: the text's bytes."""
    from pyspark.sql import types as T

    def run(batches):
        import pyarrow as pa

        coder = encoder(ranks)
        for batch in batches:
            k, j = (batch.schema.get_field_index(c) for c in ("ids", "offsets"))
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                pairs = zip(*([numbers(x) for x in part.column(c).to_pylist()] for c in (k, j)), strict=True)
                texts = [coder.decode(ids, at) for ids, at in pairs]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], [*batch.schema.names, "decoded"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("decoded", T.BinaryType())]))


def op1_byte_bpe(spark, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    ranks = path("byte_bpe_multi_50k.tiktoken")
    return decode(encode(documents(spark, sf_dir), ranks, arrays=False), ranks).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
