"""Exact removal of repeated passages with suffix arrays.

A byte goes if it lies in a string of WIDTH bytes that also starts in a document with a smaller id. Strings are judged on the
input and never cross documents.

1. Distinct texts are laid out once, in buckets by a 128-bit hash, each with its smallest id and a number; no other step moves
   texts.
2. Anchors: of the 16-byte grams in each string of WIDTH bytes, the one with the least hash. Equal strings have equal anchors,
   so only the surroundings of anchors that two texts have in common can hold repeated strings. Anchors travel to the shard of
   their hash as packed arrays, one row for each chunk of texts and shard.
3. The surroundings of the common anchors (snippets, each once a chunk) are dealt into shards by the anchor, which puts equal
   strings into one shard. A shard is cut into blocks of whole anchors, an anchor with many snippets into several; each block gets
   a suffix array by Larsson-Sadakane refinement and common prefixes by Kasai's rule, which give its distinct strings in order,
   with the smallest and largest document of each. The blocks of one anchor are merged by binary search.
4. The shard answers with the ranges that go, by text. Where a chunk has a snippet more than HOT times, its places stay out of the
   shard and meet the shard's answer in a join, which Spark can split. The ranges of a text are united and cut out.

Equal texts are one text whose document is the smallest id. Null and empty texts lose nothing. Rows without an id neither lose
nor take anything. Rows that share an id don't take from each other. Ids are integers.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import bucketed, chunks, documents, durable, looked_up, slices, utf8

WIDTH, GRAM = 50, 16
SIDE = WIDTH - GRAM  # what an anchor's strings reach to either side
CUT = 2 * SIDE + GRAM  # bytes of a snippet
ROW = -(-CUT // 8) * 8
SHARDS = 32  # at least
ANCHOR_BYTES, SNIPPET_BYTES = 32 << 20, 8 << 20  # of text for each shard of anchors and of snippets beyond that
BLOCK = 12_000  # snippets of a block, about 1 MB
CHUNK = 6 << 20  # bytes of text whose anchors are sent together
FLUSH = 60_000  # snippets that a task gathers before it sends them
HOT = 64  # places of a snippet in one flush


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(31))


def grams(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hashes of the 16-byte grams made of two 8-byte words each."""
    return mixed(mixed(first * np.uint64(0x9E3779B97F4A7C15)) + second * np.uint64(0xC2B2AE3D27D4EB4F))


def sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best over each run of `width` items, by doubling."""
    n = 1
    while n * 2 <= width:
        x, n = best(x[:-n], x[n:]), n * 2
    rest = width - n
    return best(x[:-rest], x[rest:]) if rest else x


def joined(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All bytes, and where each text starts and ends."""
    ends = np.cumsum([len(t) for t in texts])
    return b"".join(texts) + bytes(WIDTH + 16), ends - np.array([len(t) for t in texts]), ends


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's index, place, hash) of each anchor; a few texts at a time."""
    found = [(own + a, place, h) for a, b in chunks(map(len, texts), 1 << 20) for own, place, h in [_anchors(texts[a:b])]]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else _anchors([b""])


def _anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, begin, ends = joined(texts)
    n = int(ends[-1])
    if n < WIDTH:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    words = np.ndarray((n - GRAM + 9,), "<u8", data, strides=(1,)).copy()
    h = grams(words[:-8], words[8:])[: n - GRAM + 1]
    least = sliding(h, SIDE + 1, np.minimum)  # of the string that starts here
    whole = np.ones(len(least), bool)
    for e in ends[:-1].tolist():  # strings that cross an end
        whole[max(0, e - WIDTH + 1) : e] = False
    least[~whole] = 0
    edge = np.zeros(SIDE, np.uint64)
    chosen = np.flatnonzero(sliding(np.concatenate([edge, least, edge]), SIDE + 1, np.maximum) == h)
    own = np.searchsorted(ends, chosen, side="right")
    return own, chosen - begin[own], h[chosen]


def pack(x: np.ndarray) -> bytes:
    """The bytes of x by significance, compressed; unpack() needs the kind."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())


def squeezed(cut: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(cut).tobytes())


def spread(data: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(-1, CUT)


def unpack(data: bytes, kind, columns: int = 1) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize * columns
    out = np.ascontiguousarray(raw.reshape(width, -1).T)
    return out if columns > 1 else out.view(kind)[:, 0]


def runs_of(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end of each run of rows that are equal in all columns."""
    n = len(columns[0])
    if not n:
        return (np.zeros(0, np.int64),) * 2
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns])
    first = np.flatnonzero(new)
    return first, np.append(first[1:], n)


def common_here(h: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by h, whether each in that order has an anchor that another text has too)."""
    order = np.argsort(h, kind="stable")
    first, end = runs_of(h[order])
    if not len(first):
        return order, np.zeros(0, bool)
    o = own[order]
    return order, np.repeat(np.minimum.reduceat(o, first) != np.maximum.reduceat(o, first), end - first)


def packed_places(own: np.ndarray, place: np.ndarray, tid: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """(steps from text to text, how many places each has, steps from place to place), for rows in order of text and place."""
    first, end = runs_of(own)
    step = place.copy()
    step[1:] -= place[:-1]
    step[first] = place[first]
    return packed_ids(tid[own[first]]), pack((end - first).astype("<u4")), pack(step.astype("<u4"))


def unpacked_places(ids: bytes, counts: bytes, steps: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the texts, each row's text, each row's place)."""
    n, step = unpack(counts, "<u4").astype(np.int64), unpack(steps, "<u4").astype(np.int64)
    total = np.cumsum(step)
    first = np.cumsum(n) - n
    return unpacked_ids(ids), np.repeat(np.arange(len(n)), n), total - np.repeat(total[first] - step[first], n)


def packed_ids(tid: np.ndarray) -> bytes:
    return pack(np.diff(tid, prepend=np.int64(0)))


def unpacked_ids(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.int64))


def by_text(tid: np.ndarray, own: np.ndarray, place: np.ndarray):
    """An Arrow table of one row a text: its number and, as 32-bit integers, its places."""
    import pyarrow as pa

    order = np.argsort(own, kind="stable")
    first, end = runs_of(own[order])
    data = place[order].astype("<i4").tobytes()
    return pa.table({"tid": pa.array(tid[own[order][first]]), "places": pa.array([data[4 * a : 4 * b] for a, b in zip(first.tolist(), end.tolist(), strict=True)], pa.binary())})


ANCHORS = "shard int, h binary, known binary, ids binary, counts binary, steps binary"
PLACES = "tid bigint, places binary"


def common_anchors(texts: DataFrame, shards: int) -> DataFrame:
    """(tid, text) -> PLACES: anchors that several texts have. A text may have several rows."""

    def sent(batches):
        """To the shard of its hash: each anchor of one text with its places and 32 bits more of its hash (anchors that seem common are judged in full later); of anchors that the chunk itself shows to be common, the hash alone. The places of the latter go along to any shard."""
        import pyarrow as pa

        kinds = [pa.int32()] + [pa.binary()] * 5
        for batch in batches:
            for part, every in slices(batch, 1, CHUNK):
                tid = part.column(0).to_numpy()
                own, place, h = anchors(every)
                order, many = common_here(h, own)
                rows = []

                def add(own, place, shard, h=None, tid=tid, rows=rows):
                    order = np.lexsort((place, own, shard))
                    own, place, shard = own[order], place[order], shard[order]
                    for x, y in zip(*(r.tolist() for r in runs_of(shard)), strict=True):
                        rows.append((int(shard[x]), None if h is None else (h[order[x:y]] >> np.uint64(32)).astype("<u4").tobytes(), None, *packed_places(own[x:y], place[x:y], tid)))

                rest, near = order[~many], order[many]
                add(own[rest], place[rest], dealt(h[rest], shards), h[rest])
                add(own[near], place[near], own[near] % shards)
                known = np.unique(h[near])
                to = dealt(known, shards)
                known, to = known[np.argsort(to, kind="stable")], np.sort(to)
                rows += [(int(to[x]), None, (known[x:y] >> np.uint64(32)).astype("<u4").tobytes(), None, None, None) for x, y in zip(*(r.tolist() for r in runs_of(to)), strict=True)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["shard", "h", "known", "ids", "counts", "steps"])

    def met(table):
        import pyarrow as pa

        near, parts, known, n = [], [], [], 0
        for h, some, *packed in zip(*(table.column(c).to_pylist() for c in ("h", "known", "ids", "counts", "steps")), strict=True):
            if some is not None:
                known.append(np.frombuffer(some, "<u4"))
            elif h is None:
                near.append(by_text(*unpacked_places(*packed)))
            else:
                tid, own, place = unpacked_places(*packed)
                parts.append((np.frombuffer(h, "<u4"), own + n, place, tid))
                n += len(tid)
        if parts:
            h, own, place, tid = (np.concatenate([p[k] for p in parts]) for k in range(4))
            order, many = common_here(h, own)
            if known:
                every = np.unique(np.concatenate(known))
                s = h[order]
                many |= every[np.minimum(np.searchsorted(every, s), len(every) - 1)] == s
            near.append(by_text(tid, own[order][many], place[order][many]))
        return pa.concat_tables(near) if near else by_text(*(np.zeros(0, np.int64),) * 3)

    return texts.select("tid", "text").mapInArrow(sent, ANCHORS).groupBy("shard").applyInArrow(met, PLACES)


def dealt(h: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each hash, by bits that the shard's rows don't carry."""
    return ((h & np.uint64(0xFFFFFFFF)) % np.uint64(shards)).astype(np.int64)


def snippets(texts: list[bytes], places: list[np.ndarray]):
    """(bytes, first and end byte that belong to the text, text's index, snippet's first place) of each anchor."""
    data, begin, ends = joined(texts)
    data = bytes(SIDE) + data
    own = np.repeat(np.arange(len(texts)), [len(p) for p in places])
    at = np.concatenate(places).astype(np.int64) if len(places) else np.zeros(0, np.int64)
    first = at - SIDE
    low, high = np.maximum(-first, 0), np.minimum((ends - begin)[own] - first, CUT)
    raw = np.frombuffer(data, np.uint8)
    cut = np.zeros((len(at), ROW), np.uint8)
    cut[:, :CUT] = np.lib.stride_tricks.sliding_window_view(raw, CUT)[begin[own] + at]
    columns = np.arange(CUT)
    edge = np.flatnonzero((low > 0) | (high < CUT))
    cut[edge, :CUT] *= (columns >= low[edge, None]) & (columns < high[edge, None])
    return cut, low, high, own, first


def part_hash(cut: np.ndarray, first: int, end: int) -> np.ndarray:
    """A hash of the bytes from first to end of each row."""
    out = np.zeros(len(cut), np.uint64)
    for at in range(first, end, 8):
        word = np.zeros((len(cut), 8), np.uint8)
        word[:, : min(8, end - at)] = cut[:, at : min(at + 8, end)]
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + word.view("<u8")[:, 0])
    return out


def keys_of(cut: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the whole snippet, hash of its anchor): together they tell snippets apart."""
    middle = np.ascontiguousarray(cut[:, SIDE : SIDE + GRAM]).view("<u8")
    return mixed(part_hash(cut, 0, CUT) + (low.astype(np.uint64) << np.uint64(8)) + high.astype(np.uint64)), grams(np.ascontiguousarray(middle[:, 0]), np.ascontiguousarray(middle[:, 1]))


def may_share(cut: np.ndarray, small: np.ndarray, large: np.ndarray) -> np.ndarray:
    """Whether a snippet can share a string with one of another document: a string of WIDTH bytes around the anchor reaches at least SIDE / 2 bytes to one side."""
    out = np.zeros(len(cut), bool)
    half = SIDE // 2
    for h in (part_hash(cut, SIDE - half, SIDE + GRAM), part_hash(cut, SIDE, SIDE + GRAM + half)):
        order = np.argsort(h, kind="stable")
        first, end = runs_of(h[order])
        if len(first):
            out[order] |= np.repeat(np.minimum.reduceat(small[order], first) < np.maximum.reduceat(large[order], first), end - first)
    return out


def suffix_array(a: np.ndarray) -> np.ndarray:
    """The suffixes of a in order: sorted by 8 bytes, then groups of equal ones are sorted by the ranks further on, twice as far each round, until none is left."""
    n = len(a)
    words = np.ndarray((n,), ">u8", np.append(a, np.zeros(8, np.uint8)).tobytes(), strides=(1,)).astype(np.uint64)
    order = np.argsort(words, kind="stable")
    fresh = np.append(True, words[order][1:] != words[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    done = 8
    while True:
        alone = fresh & np.append(fresh[1:], True)
        todo = np.flatnonzero(~alone)
        if not len(todo):
            break
        part = order[todo]
        on = part + done
        # beyond the end the shorter suffix comes first
        key = rank[part] * (2 * n + 2 * done) + np.where(on < n, rank[np.minimum(on, n - 1)], n - 1 - on) + n + done
        by = np.argsort(key, kind="stable")
        order[todo], key = part[by], key[by]
        starts = np.append(True, key[1:] != key[:-1])
        fresh[todo] = starts
        rank[order[todo]] = np.maximum.accumulate(np.where(starts, todo, 0))
        done *= 2
    return order


def common_prefixes(a: np.ndarray, order: np.ndarray, need: int) -> np.ndarray:
    """Bytes, `need` at most, that each suffix in the order has in common with the one before it. Kasai's rule (a suffix loses one at most when its first byte goes), on many stretches side by side."""
    n = len(a)
    text = np.append(a, np.zeros(need + 1, np.uint8))
    before = np.zeros(n, np.int64)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, np.int64)
    width = 512
    at = np.arange(0, n, width)
    end = np.minimum(at + width, n)
    h = np.zeros(len(at), np.int64)
    while len(at):
        j = before[at]
        same = (h < need) & (text[at + h] == text[j + h])
        h += same
        stay = np.flatnonzero(~same)
        out[at[stay]] = h[stay]
        at[stay] += 1
        h[stay] = np.maximum(h[stay] - 1, 0)
        if (left := at < end).sum() < len(at):
            at, end, h = at[left], end[left], h[left]
    out[order[0]] = 0
    return out[order]


def strings(cut: np.ndarray, low, high, least, most):
    """The distinct strings of a block in order: (their places, their group, smallest document, largest document, bytes)."""
    flat = np.ascontiguousarray(cut[:, :CUT]).reshape(-1)
    order = suffix_array(flat)
    group = np.cumsum(common_prefixes(flat, order, WIDTH) < WIDTH)
    which, at = order // CUT, order % CUT
    real = (at >= low[which]) & (at + WIDTH <= high[which])
    order, group, which = order[real], group[real], which[real]
    if not len(order):
        return order, group, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, f"S{WIDTH}")
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    number = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
    text = np.lib.stride_tricks.sliding_window_view(flat, WIDTH)[order[starts]]
    return order, number, np.minimum.reduceat(least[which], starts), np.maximum.reduceat(most[which], starts), np.ascontiguousarray(text).view(f"S{WIDTH}")[:, 0]


def judged(cut, low, high, least, most) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(snippet, place, smallest document) of each string that documents share."""
    found = [strings(*(x[k : k + BLOCK] for x in (cut, low, high, least, most))) for k in range(0, len(cut), BLOCK)]
    keys, small, large = found[0][4], found[0][2].copy(), found[0][3].copy()
    for _, _, s, m, text in found[1:]:
        at = np.searchsorted(keys, text)
        hit = at < len(keys)
        hit[hit] = keys[at[hit]] == text[hit]
        small[at[hit]], large[at[hit]] = np.minimum(small[at[hit]], s[hit]), np.maximum(large[at[hit]], m[hit])
        keys, small, large = np.insert(keys, at[~hit], text[~hit]), np.insert(small, at[~hit], s[~hit]), np.insert(large, at[~hit], m[~hit])
    rows = []
    for k, (order, number, _, _, text) in enumerate(found):
        at = np.searchsorted(keys, text)[number] if len(found) > 1 else number
        shared = small[at] < large[at]
        place = order[shared] + k * BLOCK * CUT
        by = np.argsort(place)
        rows.append((place[by], small[at[shared]][by]))
    place, doc = (np.concatenate(x) for x in zip(*rows, strict=True))
    return place // CUT, place % CUT, doc


def by_anchor(anchor, *columns) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """judged() of snippets in the order of their anchors, a few anchors at a time: strings that are equal have one anchor."""
    first, end = runs_of(anchor)
    found = []
    for a, b in chunks((end - first).tolist(), BLOCK):
        row, at, doc = judged(*(x[first[a] : end[b - 1]] for x in columns))
        found.append((row + first[a], at, doc))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


ANSWERS = "kind int, a bigint, b bigint, data binary"  # a and b: a text's number and 0, or the hashes of a snippet
RANGES, HOT_RUNS, HOT_PLACES = range(3)
RUN = np.dtype([("first", "<i4"), ("end", "<i4"), ("doc", "<i8")])
PLACE = np.dtype([("tid", "<i8"), ("doc", "<i8"), ("place", "<i4")])


def answers(rows: list[tuple]):
    import pyarrow as pa

    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("kind", "a", "b", "data"), columns, (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)})


def crossed(run_first, run_end, place_first, place_end) -> tuple[np.ndarray, np.ndarray]:
    """For item k, each of its runs with each of its places: (runs, places)."""
    n, m = run_end - run_first, place_end - place_first
    of = np.repeat(np.arange(len(n)), n * m)
    at = np.arange(len(of)) - np.repeat(np.cumsum(n * m) - n * m, n * m)
    return run_first[of] + at // np.maximum(m[of], 1), place_first[of] + at % np.maximum(m[of], 1)


def ranges_by_text(runs: np.ndarray, places: np.ndarray) -> list[tuple]:
    """Rows of ANSWERS from pairs of RUN and PLACE: the ranges of each text that a smaller document has."""
    hit = runs["doc"] < places["doc"]
    runs, places = runs[hit], places[hit]
    order = np.argsort(places["tid"], kind="stable")
    runs, places = runs[order], places[order]
    both = np.stack([places["place"] + runs["first"], places["place"] + runs["end"]], 1).astype("<i4")
    first, end = runs_of(places["tid"])
    rows = []
    for x, y, tid in zip(first.tolist(), end.tolist(), places["tid"][first].tolist(), strict=True):
        start, stop = united(both[x:y, 0], both[x:y, 1])
        rows.append((RANGES, tid, 0, np.stack([start, stop], 1).astype("<i4").tobytes()))
    return rows


SNIPPETS = "shard int, name binary, bytes binary, ends binary, hot binary, counts binary, ids binary, docs binary, places binary"


def repeated_strings(held: DataFrame, shards: int) -> DataFrame:
    """(tid, doc, text, places) -> ANSWERS: a text and the ranges that go; a hot snippet and its RUNs; a hot snippet and some of its PLACEs."""
    names = [c.split()[0] for c in SNIPPETS.split(", ")]

    def sent(batches):
        import pyarrow as pa

        gathered: list[tuple] = []
        kinds = [pa.int32()] + [pa.binary()] * 8

        def flush():
            """Each snippet once, with its places; of hot ones those of the first and the last document. Snippets of one anchor lie together and so pack well."""
            cut, low, high, where = (np.concatenate(x) for x in zip(*gathered, strict=True))
            gathered.clear()
            key, anchor = keys_of(cut, low, high)
            shard = dealt(anchor, shards)
            order = np.lexsort((where["doc"], key, anchor, shard))
            first, end = runs_of(key[order], anchor[order])
            one, hot, where = order[first], end - first > HOT, where[order]
            sent_ = np.ones(len(where), bool)
            for x in np.flatnonzero(hot).tolist():
                sent_[first[x] + 1 : end[x] - 1] = False
            count = np.add.reduceat(sent_.astype(np.int64), first)
            few, last = where[sent_], np.cumsum(count)
            rows = []
            for x, y in zip(*(r.tolist() for r in runs_of(shard[one])), strict=True):
                i, own = one[x:y], few[last[x] - count[x] : last[y - 1]]
                tid, which = np.unique(own["tid"], return_inverse=True)
                doc = np.zeros(len(tid), np.int64)
                doc[which] = own["doc"]
                ends = np.stack([low[i], high[i]], 1).astype(np.uint8)
                places = np.stack([which.astype("<u4"), (own["place"] + SIDE).astype("<u4")], 1)
                rows.append((int(shard[one[x]]), None, squeezed(cut[i, :CUT]), pack(ends), pack(hot[x:y].astype(np.uint8)), pack(count[x:y].astype("<u4")), packed_ids(tid), pack(doc), pack(places)))
            for x in np.flatnonzero(hot).tolist():  # these places only pass through a shard
                own = where[first[x] : end[x]]
                rows.append((int(own["tid"][0] % shards), np.array([anchor[one[x]], key[one[x]]]).tobytes(), *[None] * 6, own.tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for part, texts in slices(batch, 2, 1 << 20):
                tid, docs = (part.column(c).to_numpy() for c in range(2))
                places = [np.unique(np.frombuffer(b"".join(p), "<i4")) for p in part.column(3).to_pylist()]
                cut, low, high, own, first = snippets(texts, places)
                if len(cut):
                    where = np.empty(len(cut), PLACE)
                    where["tid"], where["doc"], where["place"] = tid[own], docs[own], first
                    gathered.append((cut, low.astype(np.uint8), high.astype(np.uint8), where))
                if sum(len(x[0]) for x in gathered) > FLUSH:
                    yield flush()
        if gathered:
            yield flush()

    def met(table):
        rows, parts = [], []
        for name, data, ends, hot, counts, ids, docs, places in zip(*(table.column(c).to_pylist() for c in names[1:]), strict=True):
            if name is not None:
                rows.append((HOT_PLACES, *np.frombuffer(name, np.int64).tolist(), places))
                continue
            which = unpack(places, "<u4", 2).reshape(-1).view("<u4").reshape(-1, 2)
            where = np.empty(len(which), PLACE)
            where["tid"], where["doc"], where["place"] = unpacked_ids(ids)[which[:, 0]], unpack(docs, np.int64)[which[:, 0]], which[:, 1].astype(np.int64) - SIDE
            parts.append((spread(data), unpack(ends, np.uint8, 2), unpack(hot, np.uint8) > 0, unpack(counts, "<u4").astype(np.int64), where))
        if not parts:
            return answers(rows)
        cut, ends, hot, count, where = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts, table
        key, anchor = keys_of(cut, ends[:, 0], ends[:, 1])
        begin = np.cumsum(count) - count
        order = np.lexsort((key, anchor))
        first, end = runs_of(key[order], anchor[order])
        hot = np.maximum.reduceat(hot[order], first)
        # each snippet's places side by side
        where = where[np.repeat(begin[order] - (np.cumsum(count[order]) - count[order]), count[order]) + np.arange(len(where))]
        count, one = np.add.reduceat(count[order], first), order[first]
        last = np.cumsum(count)
        small, large = np.minimum.reduceat(where["doc"], last - count), np.maximum.reduceat(where["doc"], last - count)
        cut = cut[one]
        some = np.flatnonzero(may_share(cut, small, large))
        row, at, doc = by_anchor(anchor[one][some], cut[some], *(x[some] for x in (ends[one, 0].astype(np.int64), ends[one, 1].astype(np.int64), small, large)))
        if len(row):
            new = np.append(True, (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1]))
            start = np.flatnonzero(new)
            runs = np.empty(len(start), RUN)
            runs["first"], runs["end"], runs["doc"] = at[start], at[np.append(start[1:], len(row)) - 1] + WIDTH, doc[start]
            x, y = runs_of(row[start])
            snippet = some[row[start][x]]
            pairs = crossed(x, y, last[snippet] - count[snippet], last[snippet])
            rows += ranges_by_text(runs[pairs[0]], where[pairs[1]])
            for k in np.flatnonzero(hot[snippet]).tolist():
                s = one[snippet[k]]
                rows.append((HOT_RUNS, *np.array([anchor[s], key[s]]).view(np.int64).tolist(), runs[x[k] : y[k]].tobytes()))
        return answers(rows)

    return held.mapInArrow(sent, SNIPPETS).groupBy("shard").applyInArrow(met, ANSWERS)


def hot_ranges(found: DataFrame) -> DataFrame:
    """ANSWERS of hot snippets -> (tid, data): their places' ranges."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for runs, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, where = np.frombuffer(runs, RUN), np.frombuffer(places, PLACE)
                pairs = crossed(np.array([0]), np.array([len(own)]), np.array([0]), np.array([len(where)]))
                rows += ranges_by_text(own[pairs[0]], where[pairs[1]])
            out = answers(rows).select(["a", "data"]).rename_columns(["tid", "data"])
            yield from out.to_batches()

    runs = found.where(F.col("kind") == HOT_RUNS).select("a", "b", F.col("data").alias("runs"))
    places = found.where(F.col("kind") == HOT_PLACES).select("a", "b", F.col("data").alias("places"))
    return runs.hint("merge").join(places, ["a", "b"]).select("runs", "places").mapInArrow(run, "tid bigint, data binary")


def united(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges that overlap or touch, made one."""
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(end[order])
    new = np.append(True, first[1:] > end[:-1])
    return first[new], end[np.append(new[1:], True)]


def removed(whole: DataFrame) -> DataFrame:
    """(k, lo, doc, n, text, data) -> k, lo, doc, n, spans (removed ranges of bytes) and kept, the remaining bytes; the last two null where nothing goes."""

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                spans, kept = [], []
                for text, data in zip(utf8(part.column(4)), part.column(5).to_pylist(), strict=True):
                    if data is None:
                        spans.append(None)
                        kept.append(None)
                        continue
                    ranges = np.frombuffer(b"".join(data), "<i4").reshape(-1, 2)
                    first, end = united(ranges[:, 0].astype(np.int64), ranges[:, 1].astype(np.int64))
                    spans.append([{"first": a, "end": b} for a, b in zip(first.tolist(), end.tolist(), strict=True)])
                    kept.append(b"".join(text[a:b] for a, b in zip([0, *end.tolist()], [*first.tolist(), len(text)], strict=True)))
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(spans, kind), pa.array(kept, pa.binary())], ["k", "lo", "doc", "n", "spans", "kept"])

    return whole.select("k", "lo", "doc", "n", "text", "data").mapInArrow(run, "k bigint, lo bigint, doc bigint, n bigint, spans array<struct<first:int,end:int>>, kept binary")


def hashed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and the 128 bits that a text is known by: k and lo."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return docs.withColumn("k", F.xxhash64("text")).withColumn("lo", F.xxhash64(F.lit(1), "text"))


def _cut(docs: DataFrame) -> tuple[DataFrame, int]:
    """hashed() rows -> (k, lo, doc (the smallest id with this text), n (how many rows have it), spans, kept; only texts with several rows or with something to go; and the number of rows)."""
    named = docs.where((F.octet_length("text") >= WIDTH) & F.col("doc_id").isNotNull())
    # equal texts fall together before the shuffle, so a text that many rows have costs a row for each task
    each = named.groupBy("k", "lo").agg(F.min("doc_id").alias("doc"), F.count("*").alias("n"), F.first("text").alias("text"))
    texts = bucketed(each.withColumn("size", F.octet_length("text")).withColumn("tid", F.monotonically_increasing_id()), ["k", "lo"], "texts", dealt=True)
    total, rows = texts.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards, finer = int(max(SHARDS, total // ANCHOR_BYTES)), int(max(SHARDS, total // SNIPPET_BYTES))
    names = texts.select("tid", "k", "lo")
    places = common_anchors(texts, shards).groupBy("tid").agg(F.collect_list("places").alias("places"))
    held = texts.select("k", "lo", "doc", "text").join(places.join(names, "tid").hint("merge"), ["k", "lo"]).select("tid", "doc", "text", "places")
    found = durable(repeated_strings(held, finer), "repeated strings")
    ranges = found.where(F.col("kind") == RANGES).select(F.col("a").alias("tid"), "data").unionByName(hot_ranges(found))
    ranges = ranges.groupBy("tid").agg(F.collect_list("data").alias("data")).join(names, "tid").drop("tid")
    whole = texts.join(ranges.hint("merge"), ["k", "lo"], "left").where("n > 1 or data is not null")
    return removed(whole), rows


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of df: doc_id, text, spans (removed ranges of bytes) and kept, the remaining bytes."""
    docs = hashed(df, id_col, text_col)
    cut, total = _cut(docs)
    cut = durable(cut, "cut texts")
    needs = (F.octet_length("text") >= WIDTH) & F.col("doc_id").isNotNull()
    owned = looked_up(docs, cut.select("k", "lo", "n", "doc"), ["k", "lo"], "n", total, needs)
    own = cut.where("spans is not null").select(F.col("k").alias("_k"), F.col("lo").alias("_lo"), F.col("doc").alias("_doc"), "spans", "kept")
    whole = owned.join(own, (F.col("k") == F.col("_k")) & (F.col("lo") == F.col("_lo")) & (F.col("doc_id") == F.col("_doc")), "left")
    size = F.octet_length("text")
    copy = (F.col("doc_id") > F.col("doc")) & (size >= WIDTH)
    all_ = F.array(F.struct(F.lit(0).alias("first"), size.alias("end")))
    none = F.array().cast("array<struct<first:int,end:int>>")
    return whole.select("doc_id", "text", F.when(copy, all_).otherwise(F.coalesce("spans", none)).alias("spans"), F.when(copy, F.lit(b"")).otherwise(F.coalesce("kept", F.encode("text", "UTF-8"))).alias("kept"))


def op9_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    docs = hashed(documents(spark, sf_dir), "doc_id", "text")
    cut, total = _cut(docs)
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda s, r: s + r["end"] - r["first"])
    cut = durable(cut.select("k", "lo", "n", "doc", gone.alias("gone"), F.size("spans").cast("long").alias("runs"), F.sha2("kept", 256).alias("left")), "cut texts")
    rows = docs.select("doc_id", "k", "lo", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("same"))
    needs = (F.col("n_bytes") >= WIDTH) & F.col("doc_id").isNotNull()
    found = looked_up(rows, cut, ["k", "lo"], "n", total, needs)
    copy, some = (F.col("doc_id") > F.col("doc")) & (F.col("n_bytes") >= WIDTH), F.col("left").isNotNull() & (F.col("doc_id") == F.col("doc"))
    zero = F.lit(0).cast("long")
    return found.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).when(some, F.col("gone")).otherwise(zero).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).when(some, F.col("runs")).otherwise(zero).alias("n_spans"),
        F.when(copy, F.lit(sha256(b"").hexdigest())).when(some, F.col("left")).otherwise(F.col("same")).alias("kept_sha256"),
    )
