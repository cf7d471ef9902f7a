"""Operators over the corpus against brute force: near duplicates, repeats, language models, mixing, the pipeline."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import fixtures as fx
from tidewell.llm import kneser, lm, mixing, neardup, substrings


def brute_components(docs, size, percent=80):
    sets, root = {}, {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
        root[i] = i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(spark, size):
    docs = fx.documents(spark)
    got = fx.by_id(neardup.near_duplicates(docs, size=size))
    want = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()], size)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_near_duplicates_star_and_chain(spark):
    """Copies of one text that differ from each other too much, and a chain whose ends are far apart."""
    words = [f"w{k}" for k in range(200)]
    rows = [(0, " ".join(words))]
    for k in range(30):
        own = list(words)
        for j in range(4):
            own[(k * 37 + j * 49) % 200] = f"new{k}-{j}"
        rows.append((100 - k, " ".join(own)))
    step = [f"c{k}" for k in range(100)]
    for k in range(12):
        rows.append((200 + k, " ".join(step)))
        step[k * 8 : k * 8 + 2] = [f"d{k}", f"e{k}"]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = fx.by_id(neardup.near_duplicates(docs, size=4))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == brute_components(rows, 4)


def test_near_duplicates_odd_rows(spark):
    got = neardup.near_duplicates(fx.odd(spark), size=4).collect()
    assert len(got) == fx.odd(spark).count()
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    assert neardup.near_duplicates(fx.empty(spark)).isEmpty()


def brute_removed(docs):
    first = {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    out = {}
    for i, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        out[i] = bytes(x for x, g in zip(b, gone.tolist(), strict=False) if not g)
    return out


def test_repeats(spark):
    long = "zero " * 40
    docs = fx.documents(spark).select("doc_id", "text").unionByName(spark.createDataFrame([(900, "\0" * 300), (901, "ab" + "\0" * 300), (902, long * 3), (903, "q" + long)], "doc_id bigint, text string"))
    want = brute_removed([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = fx.by_id(substrings.remove_repeats(docs))
    assert {i: bytes(r["kept"]) for i, r in got.items()} == want
    assert all(sum(s["end"] - s["first"] for s in r["spans"]) == len((r["text"] or "").encode()) - len(r["kept"]) for r in got.values())
    assert substrings.remove_repeats(fx.empty(spark)).isEmpty()
    odd = substrings.remove_repeats(fx.odd(spark)).collect()
    assert len(odd) == fx.odd(spark).count()


def test_suffix_arrays():
    draw = np.random.default_rng(0)
    for n, k, zeros in ((1, 2, 0), (2, 1, 0), (9, 1, 5), (50, 1, 0), (300, 2, 40), (3000, 3, 0), (2000, 256, 40)):
        a = np.append(draw.integers(0, k, n), np.zeros(zeros)).astype(np.uint8)
        b = a.tobytes()
        order = substrings.suffix_array(a)
        assert order.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        for x, got in zip(range(1, len(order)), substrings.common_prefixes(a, order, 50)[1:].tolist(), strict=True):
            i, j, m = int(order[x - 1]), int(order[x]), 0
            while m < 50 and max(i, j) + m < len(b) and b[i + m] == b[j + m]:
                m += 1
            assert got == m or (got > m and max(i, j) + m == len(b))


def test_blocks_merge(monkeypatch, spark):
    """Several blocks a shard give what one block gives."""
    draw = np.random.default_rng(1)
    cut = draw.integers(0, 2, (40, substrings.ROW)).astype(np.uint8)
    cut[20:] = cut[:20][::-1]
    args = (cut, np.zeros(40, np.int64), np.full(40, substrings.CUT), np.arange(40), np.arange(40))
    want = [x.tolist() for x in substrings.judged(*args)]
    monkeypatch.setattr(substrings, "BLOCK", 7)
    assert [x.tolist() for x in substrings.judged(*args)] == want


@pytest.mark.parametrize("head", [10, 10_000])
def test_lm(spark, head):
    docs = fx.documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    model = lm.Model(docs.where(~lm.held_out()).select("text"), classes=12, head=head)
    got = fx.by_id(lm.score(docs, model))
    counts = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 10:
            counts.update([*(t or "").encode().lower().split(), b""])
    n, v = counts.total(), len(counts)
    assert (model.tokens, model.distinct) == (n, v)
    for i, t in rows:
        w = [*(t or "").encode().lower().split(), b""]
        assert got[i]["n_tokens"] == len(w)
        assert got[i]["n_known"] == sum(counts[x] > 0 for x in w)
        assert abs(got[i]["base_score"] - sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) < 1e-6
        assert got[i]["score"] < 0
    assert np.allclose((10.0 ** model.table.astype(float)).sum(1), 1, atol=1e-4)
    assert sum(r["score"] for r in got.values()) > sum(r["base_score"] for r in got.values())


def test_lm_edges(spark):
    assert lm.score(fx.empty(spark), lm.Model(fx.empty(spark).select("text"))).isEmpty()
    docs = fx.odd(spark)
    assert lm.score(docs, lm.Model(fx.empty(spark).select("text"))).count() == docs.count()


def test_mixing(spark):
    docs = spark.createDataFrame([(k, "w " * (k % 90), "en", ["a", "b", "b", "b", "é", None][k % 6], 1) for k in range(3000)], fx.SCHEMA)
    own = mixing.mix(docs)
    got = own.taken.collect()
    assert sorted(r["doc_id"] for r in got) == list(range(3000))
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    for n, t in zip(own.totals, own.targets, strict=True):
        taken = sum(r["taken"] for r in got if (r["source_size"], r["target"]) == (n, t))
        assert abs(taken - t) < 0.03 * t
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs.repartition(5)).taken.collect()))


def test_targets_and_permutation():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == [50.0, 100.0, 150.0]
    got = mixing.targets([10, 100, 1000], [1, 1, 1])
    assert got[0] == 30 and got[1] == 300 and abs(sum(got) - 1110) < 1e-9
    assert mixing.targets([0, 0], [1, 2]) == [0.0, 0.0]
    for n in (1, 2, 3, 7, 64, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 12345).tolist()) == list(range(n))
    quota = np.array([70, 0, 3, 500])
    draws = [mixing.draw(quota, 9, k, 64, 1) for k in range(9)]
    assert sum(c for _, c in draws).tolist() == quota.tolist()
    assert all((draws[k][0] + draws[k][1] == draws[k + 1][0]).all() for k in range(8))


def test_mixing_edges(spark):
    assert mixing.mix(fx.empty(spark)).taken.isEmpty()
    assert mixing.mix(fx.odd(spark)).taken.agg(F.sum("size")).first()[0] == mixing.mix(fx.odd(spark)).sizes.agg(F.sum("size")).first()[0]


def test_mix_of_many_sources(spark):
    """Sources as a table: the same targets and quotas, each slot once, blocks by whole passes, reruns agree."""
    docs = fx.documents(spark).withColumn("source", F.when(F.col("doc_id") % 5 == 0, None).otherwise(F.concat(F.lit("s"), (F.col("doc_id") % 23).cast("string"))))
    few, many = mixing.Mix(docs, "doc_id", "text", "source"), mixing.ManySources(docs)
    a = {r["doc_id"]: (r["size"], r["source_size"], r["first"]) for r in few.sizes.collect()}
    assert a == {r["doc_id"]: (r["size"], r["source_size"], r["first"]) for r in many.sizes.collect()}
    want = {r["doc_id"]: r["target"] for r in few.sizes.collect()}
    assert all(abs(r["target"] - want[r["doc_id"]]) < 1e-6 * max(1, want[r["doc_id"]]) for r in many.sizes.collect())
    assert [r["quota"] for r in many.table.orderBy("source_no").collect()] == few.quota.tolist()
    slots = many.slots.collect()
    assert sorted(r["shard"] * mixing.SHARD_SLOTS + r["slot"] for r in slots) == list(range(many.total))
    times = Counter((r["source_no"], r["block"]) for r in slots)
    for k, (quota, blocks) in enumerate(zip(few.quota.tolist(), few.blocks, strict=True)):
        own = [times[k, b] for b in range(blocks)]
        assert sum(own) == quota and (not own or max(own) - min(own) <= 1)
    x = sorted((r["doc_id"], r["taken"]) for r in many.taken.collect())
    assert x == sorted((r["doc_id"], r["taken"]) for r in mixing.ManySources(docs.repartition(7)).taken.collect())
    assert all(t <= 3 * a[i][0] for i, t in x)
    assert mixing.ManySources(fx.empty(spark)).taken.isEmpty()
    most, mixing.MOST_SOURCES = mixing.MOST_SOURCES, 3
    try:
        assert isinstance(mixing.mix(docs), mixing.ManySources)
    finally:
        mixing.MOST_SOURCES = most


def test_kneser_sums_to_one(spark):
    model = kneser.Model(spark.createDataFrame([("a b a c a b",), ("b a c",), ("a b d",)], "text string"))
    for before in ([kneser.BEGIN, kneser.BEGIN], [kneser.BEGIN, 3], [3, 4], [4, 3], [0, 0], [5, 0]):
        words = np.arange(model.size)
        p = [10 ** model.log10(np.array([*before, w]))[0] for w in words]
        assert abs(sum(p) - 1) < 1e-5


def test_kneser_keys_of_many_words(spark):
    """Keys of trigrams stay apart where three numbers of words don't fit 64 bits."""
    far = {b"a": 0, b"b": 1, b"c": 2}
    size = 3_000_000
    number = {w: size - 9 + k for w, k in far.items()}
    counts = {(r["context"], r["w"]): r["n"] for r in kneser.count(spark.createDataFrame([("a b a b a b c",)], "text string"), number, size).collect()}
    a, b, c = (number[w] for w in (b"a", b"b", b"c"))
    assert counts == {(2 * size + 2, a): 1, (2 * size + a, b): 1, (a * size + b, a): 2, (b * size + a, b): 2, (a * size + b, c): 1, (b * size + c, 1): 1}


def test_kneser_tells_noise(spark):
    rows = [(k, " ".join(f"w{(k * 7 + j * j) % 23}" for j in range(60)), "en", "a", 1) for k in range(300)]
    rows += [(1000 + k, " ".join(f"noise{k}x{j}" for j in range(60)), "en", "a", 1) for k in range(20)] + [(5000, None, None, None, None), (5001, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, fx.SCHEMA)
    got = fx.by_id(kneser.classify(docs, docs.where("doc_id < 300").select("doc_id")))
    assert all(got[k]["kept"] for k in range(300))
    assert not any(got[k]["kept"] for k in got if k >= 1000)
    assert got[5000]["perplexity"] is None
    assert kneser.classify(fx.empty(spark), fx.empty(spark).select("doc_id")).isEmpty()


def test_kneser_whole_texts(spark):
    late = "late Überall words that come beyond the first thousand"
    rows = [(k, " ".join(["filler"] * 1000 + [late]), "en", "a", 1) for k in range(40)] + [(100, late, "en", "a", 1), (101, " ".join(f"unseen{k}" for k in range(9)), "en", "a", 1)]
    docs = spark.createDataFrame(rows, fx.SCHEMA)
    got = fx.by_id(kneser.classify(docs, docs.where("doc_id < 100").select("doc_id")))
    assert got[100]["perplexity"] * 2 < got[101]["perplexity"]


def test_kneser_capitals(spark):
    model = kneser.Model(spark.createDataFrame([("Überall ÉTÉ The",)], "text string"))
    assert set(model.number) == set(kneser.words_of("Überall ÉTÉ The".encode()))


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = fx.documents(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    step, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, step, str(tmp_path))
        if name != "tokens":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name.replace(' ', '')}")
        step = seen[name] = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '')}")
    near = brute_components([(r["doc_id"], r["text"]) for r in seen["quality rules"].collect()], 5)
    assert {r["doc_id"] for r in seen["near duplicates"].collect()} == {i for i, (_, c) in near.items() if c == i}
    assert seen["tokens"].count() == seen["source mix"].count()
    whole = corpus_pipeline.run(spark, str(tmp_path))
    digest = lambda df: sorted((r["doc_id"], hashlib.sha256(r["ids"]).hexdigest()) for r in df.collect())
    assert digest(whole) == digest(seen["tokens"])
