"""Each query of this subpackage over a small table, against its contract worked out by hand."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import fixtures as fx
from tests.llm.test_corpus_operators import brute_components, brute_removed
from tests.llm.test_text_operators import base_by_hand, library, rules_by_hand  # noqa: F401
from tidewell.llm import kneser, licences, lm, media, mixing, queries

Q = queries.QUERIES


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    more = ["mail jo.doe@example.org, card 4111 1111 1111 1111, ip 10.0.0.255 or 10.0.0.256, +1 (499) 555-6503", "Ask. Licensed under the MIT License. Or not.", licences.TEMPLATES["ISC"], "All rights reserved\nHome | News | About | Us\nA last line of some words."]
    rows = fx.rows() + [(2000 + k, t, "en", "b", len(t)) for k, t in enumerate(more)]
    docs = spark.createDataFrame(rows, fx.SCHEMA).select("*", *(F.lit("mine").alias(c.split()[0]) for c in fx.CLASHES.split(", ")))
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(r[0], int(k % 4 > 0), int(k % 9 == 0)) for k, r in enumerate(rows)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def rows_of(spark, sf, name):
    return fx.by_id(Q[name](spark, sf))


def test_op1(spark, sf, texts, library):  # noqa: F811
    got = rows_of(spark, sf, "op1_byte_bpe")
    for i, t in texts.items():
        ids = library.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


class KneserByHand:
    """Interpolated modified Kneser-Ney with dictionaries."""

    def __init__(self, texts):
        self.known = {w for t in texts for w in t.encode().lower().split()}
        tri = Counter()
        for t in texts:
            w = [0, 0, *t.encode().lower().split(), 1]
            tri.update(zip(w, w[1:], w[2:], strict=False))
        two = Counter()
        for (_, b, c), n in tri.items():
            two[b, c] += n if b == 0 else 1  # nothing comes before a text: raw counts
        one = Counter((c,) for _, c in two)
        self.levels = [self.level(x) for x in (one, two, tri)]
        self.size = len(self.known) + 3

    def level(self, counts):
        n = [sum(v == k for v in counts.values()) for k in (1, 2, 3, 4)]
        if not (n[0] and n[1]):
            d = (0.5, 0.5, 0.5)
        else:
            y = n[0] / (n[0] + 2 * n[1])
            d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 3 - 4 * y]
            d = [min(max(x, 0.05), k + 0.95) for k, x in enumerate(d)]
        total, free = defaultdict(float), defaultdict(float)
        for key, v in counts.items():
            total[key[:-1]] += v
            free[key[:-1]] += d[min(v, 3) - 1]
        return counts, d, total, free

    def p(self, key):
        counts, d, total, free = self.levels[len(key) - 1]
        lower = self.p(key[1:]) if len(key) > 1 else 1 / self.size
        if not total[key[:-1]]:
            return lower
        v = counts[key]
        return ((v - d[min(v, 3) - 1]) if v else 0) / total[key[:-1]] + free[key[:-1]] / total[key[:-1]] * lower

    def perplexity(self, text):
        w = [x if x in self.known else 2 for x in (text or "").encode().lower().split()]
        path = [0, 0, *w, 1]
        return 10 ** (-sum(math.log10(self.p(k)) for k in zip(path, path[1:], path[2:], strict=False)) / (len(w) + 1)) if w else None


def test_op2(spark, sf, texts):
    got = rows_of(spark, sf, "op2_quality_classifier")
    trusted = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1 and toxic = 0")
    train = [r[0] for r in trusted.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(5)) > 0).select("doc_id").collect()]
    model = KneserByHand([texts[i] for i in train if texts[i] is not None])
    assert len(got) == len(texts) and train
    for i, t in texts.items():
        want = model.perplexity(t)
        assert (got[i]["perplexity"] is None) == (want is None)
        if want:
            assert abs(math.log(got[i]["perplexity"] / want)) < 1e-3
            assert got[i]["kept"] == (got[i]["perplexity"] <= got[i]["threshold"])
    held = sorted(model.perplexity(texts[r[0]]) for r in trusted.collect() if r[0] not in train and (texts[r[0]] or "").split())
    assert abs(max(r["threshold"] for r in got.values()) / (held[math.ceil(kneser.QUANTILE * len(held)) - 1] * kneser.MARGIN) - 1) < 1e-3


def test_op3(spark, sf, texts):
    duckdb = pytest.importorskip("duckdb")
    got = Q["op3_quality_rules"](spark, sf)
    own = sorted(map(tuple, got.collect()))
    assert own == sorted((i, *rules_by_hand(t)) for i, t in texts.items())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet/*.parquet')")
    assert own == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL['op3_quality_rules']})").fetchall())


def test_op4(spark, sf, texts):
    got = rows_of(spark, sf, "op4_licence_scan")
    assert got[2001]["licence"] == "MIT (short)" and got[2002]["licence"] == "ISC" and got[2002]["dice"] == 1.0
    assert {i for i, r in got.items() if r["n_matches"]} == {2001, 2002} and len(got) == len(texts)


def test_op5(spark, sf, texts):
    got = rows_of(spark, sf, "op5_media_columns")
    for i, t in texts.items():
        raw, r = (t or "").encode(), got[i]
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
        stored = media.container(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        n, keys = len(payload) // 64, -(-(len(payload) // 64) // media.KEY_EVERY)
        first = stored.rindex(payload) + (keys - 1) * media.KEY_EVERY * 64
        assert r["feature"] == f"codec=raw;duration={len(payload)}/8000;samples={n};keyframes={keys};last={first}-{first + 64}"


def test_media_with_wild_counts():
    whole = media.container(media.padded(b"some bytes" * 50))
    for kind, places in ((b"stsz", (8, 12)), (b"stsc", (8, 16)), (b"stco", (8,)), (b"stss", (8,)), (b"stts", (8,))):
        at = whole.index(kind) + 4
        for k in places:
            for value in (0, 1, 2**16, 2**31 - 1, 2**32 - 1):
                x = bytearray(whole)
                x[at + k - 4 : at + k] = struct.pack(">I", value)
                media.probe(bytes(x))
    at = whole.index(b"moov") - 4
    assert media.probe(whole[:at] + media.box(b"moov", media.box(b"trak")) + media.box(b"moof"))[-1]


def test_media_tracks():
    """A file with two tracks: both are told, the payload is the first one's."""
    whole = media.container(media.padded(b"some bytes"))
    at, end = next((a - 8, b) for path, a, b in media.boxes(whole, 0, len(whole)) if path[-1] == b"moov")
    trak = next(whole[a - 8 : b] for path, a, b in media.boxes(whole, 0, len(whole)) if path[-1] == b"trak")
    moov = whole[at:end] + trak.replace(b"soun", b"vide")
    both = whole[:at] + struct.pack(">I", len(moov)) + moov[4:] + whole[end:]
    # sample places are counted from the file's start
    both = both.replace(struct.pack(">I", len(whole) - 64), struct.pack(">I", len(both) - 64))
    row = media.probe(both)
    assert row[-1] is None and [t["handler"] for t in row[5]] == ["soun", "vide"] and row[6] == media.padded(b"some bytes")
    assert row[5][0]["keyframes"] == row[5][1]["keyframes"] == row[4]


NAMES = ("email", "ip", "card", "phone")


def test_op6(spark, sf, texts):
    got = rows_of(spark, sf, "op6_pii")
    for i, t in texts.items():
        base = base_by_hand(t or "")
        assert [got[i][f"n_{n}"] for n in NAMES] == [sum(k == j for _, k, _ in base) for j in range(4)]
        written = ",".join(f"{NAMES[k]}:{a}:{b}" for a, k, b in base)
        assert got[i]["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        assert set(filter(None, written.split(","))) <= set(got[i]["spans"].split(","))
        assert got[i]["n_spans"] == len([s for s in got[i]["spans"].split(",") if s])


def test_op7(spark, sf, texts):
    got = rows_of(spark, sf, "op7_minhash_near_dedup")
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == brute_components(list(texts.items()), 4)
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_op8(spark, sf, texts):
    got = rows_of(spark, sf, "op8_lm_scoring")
    words = {i: [*(t or "").encode().lower().split(), b""] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    c = Counter(w for i in texts if not held[i] for w in words[i])
    n, v = c.total(), len(c)
    model = lm.Model(spark.read.parquet(f"{sf}/documents.parquet").where(~lm.held_out()).select("text"))
    own = lambda w: 0 if not w else model.number.get(w) or lm.ending(w)
    rest, kinds = Counter(), Counter()
    for w in c:
        if w and w not in model.number:
            rest[own(w)] += c[w]
            kinds[own(w)] += 1
    for i, t in words.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(t), sum(c[w] > 0 for w in t), n)
        assert abs(r["base_score"] - sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) < 1e-6
        path = [0, *map(own, t)]
        want = sum(float(model.table[a, b]) for a, b in zip(path, path[1:], strict=False))
        want += sum(math.log10((c[w] + 0.1) / (rest[own(w)] + 0.1 * (kinds[own(w)] + 1))) for w in t if w and w not in model.number)
        assert abs(r["score"] - want) < 1e-3 * max(1, abs(want))


def test_op9(spark, sf, texts):
    got = rows_of(spark, sf, "op9_suffix_array_dedup")
    kept = brute_removed(list(texts.items()))
    for i, t in texts.items():
        n = len((t or "").encode())
        assert (got[i]["n_bytes"], got[i]["n_removed"]) == (n, n - len(kept[i]))
        assert got[i]["kept_sha256"] == hashlib.sha256(kept[i]).hexdigest()
        assert (got[i]["n_spans"] > 0) == (got[i]["n_removed"] > 0)


def test_op10(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()
    got = rows_of(spark, sf, "op10_source_mixing")
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in docs}
    sources = sorted({r["source"] for r in docs}, key=lambda s: (s is None, s or ""))
    whole = {s: sum(size[r["doc_id"]] for r in docs if r["source"] == s) for s in sources}
    # the level at which min(3 * size, level * weight) adds up to all words
    weight = {s: 1 + k % 3 for k, s in enumerate(sources)}
    low, high = 0.0, float(sum(whole.values())) * 3
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(3 * whole[s], mid * weight[s]) for s in sources) < sum(whole.values()) else (low, mid)
    for r in docs:
        x = got[r["doc_id"]]
        assert (x["size"], x["source_size"]) == (size[r["doc_id"]], whole[r["source"]])
        assert abs(x["target"] - min(3 * whole[r["source"]], high * weight[r["source"]])) < 1e-3 * max(1, x["target"])
        assert 0 <= x["taken"] <= 3 * x["size"]
    for s in sources:
        taken = sum(got[r["doc_id"]]["taken"] for r in docs if r["source"] == s)
        target = min(3 * whole[s], high * weight[s])
        assert abs(taken - target) <= 2 * mixing.BLOCK_WORDS + 0.01 * target


def test_draws_of_any_size():
    draw = np.random.default_rng(0)
    for counts in ([3, 0, 5], [1, 1, 1], [10**13, 7, 10**12], [0, 0]):
        counts = np.array(counts)
        for some in {min(n, int(counts.sum())) for n in (0, 1, 5, 1000)}:
            got = mixing.picked(draw, counts, some)
            assert got.sum() == some and (got >= 0).all() and (got <= counts).all()
    own = np.array([10**12, 10**6, 5, 0])
    for left in (0, 1, int(own.sum()) // 2, int(own.sum())):
        part = mixing.halved(own, left, 3)
        assert part.sum() == left and (part >= 0).all() and (part <= own).all()
    # all sets of a given number of slots are as likely
    seen = Counter(tuple(mixing.halved(np.array([1, 1, 1, 1]), 2, k).tolist()) for k in range(6000))
    assert len(seen) == 6 and all(abs(n - 1000) < 150 for n in seen.values())


def test_pipeline_names(spark, tmp_path):
    """Columns with the names that stages once used for themselves."""
    import corpus_pipeline

    docs = fx.documents(spark).select("*", *(F.lit(7).alias(c) for c in ("_kept", "_id", "_copy", "_share", "_times", "clean", "key", "share", "times", "copy")))
    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, step, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name.replace(' ', '')}")
        step = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '')}")
        assert step.where("_kept <> 7 or _id <> 7 or _copy <> 7 or kept <> 'mine' or copy <> 7").isEmpty() and not step.isEmpty()


def test_pipeline_by_hand(spark, sf, library, tmp_path):  # noqa: F811
    """Each stage on what the one before kept, worked out by hand."""
    import corpus_pipeline
    from tidewell.llm import pii, tagger

    step, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name, 0] = step.collect()
        stage(spark, step, sf).write.parquet(f"{tmp_path}/{name.replace(' ', '')}")
        step = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '')}")
        seen[name, 1] = step.collect()
    texts_of = lambda rows: {r["doc_id"]: r["text"] for r in rows}
    before, after = (texts_of(seen["quality rules", k]) for k in (0, 1))
    assert set(after) == {i for i, t in before.items() if rules_by_hand(t)[-1]}
    assert all(set(t.split("\n")) <= set(before[i].split("\n")) for i, t in after.items())
    assert all(r["n_chars"] == len(r["text"]) for r in seen["quality rules", 1])
    near = brute_components(list(texts_of(seen["near duplicates", 0]).items()), 5)
    assert texts_of(seen["near duplicates", 1]) == {i: t for i, t in after.items() if near[i][1] == i}
    clean = {i: pii.reports(tagger.trained(), [t], True)[0][-1] for i, t in texts_of(seen["personal data", 0]).items()}
    assert texts_of(seen["personal data", 1]) == clean
    taken = fx.by_id(mixing.mix(spark.read.parquet(f"{tmp_path}/personaldata")).taken)
    times = Counter(r["doc_id"] for r in seen["source mix", 1])
    for i, r in taken.items():
        share = r["taken"] / max(1, r["size"])
        assert math.floor(share) <= times[i] <= math.ceil(share)
    tokens = sorted((r["doc_id"], bytes(r["ids"])) for r in seen["tokens", 1])
    assert tokens == sorted((r["doc_id"], struct.pack(f"<{len(x)}I", *x)) for r in seen["tokens", 0] for x in [library.encode_ordinary(r["text"])])


@pytest.mark.parametrize("total", [1, 40_000, 10**9])
def test_lookups_of_hot_and_cold_keys(spark, total):
    from tidewell.llm.common import looked_up

    keys = [k for k in range(30) for _ in range(1 + 4 * k)] + [None, 99]
    rows = spark.createDataFrame([(i, k, (k or 0) % 7) for i, k in enumerate(keys)], "i int, k bigint, lo bigint")
    table = spark.createDataFrame([(k, k % 7, 1 + 4 * k, f"v{k}") for k in range(0, 30, 2)], "k bigint, lo bigint, n bigint, v string")
    got = {r["i"]: r["v"] for r in looked_up(rows, table, ["k", "lo"], "n", total, F.col("i") % 10 > 0).collect()}
    assert got == {i: f"v{k}" if k is not None and k < 30 and k % 2 == 0 and i % 10 else None for i, k in enumerate(keys)}
