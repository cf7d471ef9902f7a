"""op11 and op12 over vectors with every edge, against brute force, and the trees and bounds that they rely on."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import codes, negatives, queries
from tidewell.llm.vectors import reach

SCHEMA = "vec_id bigint, embedding array<float>, label int, v string, row string, cell string"


def clustered(n=420, seed=0, width=64):
    """Clusters, a third of exact and near copies, unit vectors, and rows that can't be used."""
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(6, width))
    out = []
    for k in range(n):
        x = centres[k % 6] + draw.normal(size=width) * 0.4 if k % 3 else centres[0] + (k % 2) * draw.normal(size=width) * 0.01
        x = x / np.linalg.norm(x) if k % 5 else x
        out.append((k, x.astype(np.float32).tolist(), None if k % 41 == 7 else k % 6, "v", "r", "c"))
    bad = [None, [], [1.0, None] + [0.0] * (width - 2), [float("nan")] * width, [float("inf")] + [0.0] * (width - 1)]
    return out + [(n + k, x, 1, "v", "r", "c") for k, x in enumerate(bad) if x != []]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def usable(rows):
    return [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]


def codes_by_hand(rows, entries=256):
    kept = sorted(usable(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([[math.floor(1024 * y) for y in r[1]] for r in kept], dtype=object).reshape(len(kept), len(kept[0][1]) if kept else 0)
    books, own = [], x.shape[1] // 4 if len(kept) else 0
    parts = [x[:, k * own : (k + 1) * own] for k in range(4)]
    books = [p[:entries].copy() for p in parts]

    def nearest(p, b):
        d = ((p[:, None, :] - b[None]) ** 2).sum(2)
        at = [min(range(len(b)), key=lambda k: (row[k], k)) for row in d]
        return np.array(at), [row[k] for row, k in zip(d, at, strict=True)]

    for _ in range(4 if kept else 0):
        for p, b in zip(parts, books, strict=True):
            at, _ = nearest(p, b)
            for e in set(at.tolist()):
                own_rows = p[at == e]
                b[e] = [s // len(own_rows) for s in own_rows.sum(0)]
    found = [nearest(p, b) for p, b in zip(parts, books, strict=True)] if kept else []
    error = [sum(f[1][k] for f in found) for k in range(len(kept))]
    by_label = {}
    for r, e in zip(kept, error, strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((r[0] is None, r[0] or 0, "".join(f"{f[0][k]:02x}" for f in found), error[k], by_label[r[2]], digest) for k, r in enumerate(kept))


def coded(spark, tmp_path, rows):
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.QUERIES["op11_vector_codes"](spark, str(tmp_path)).collect()
    return sorted((r["vec_id"] is None, r["vec_id"] or 0, r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got)


@pytest.mark.parametrize("kind", ["whole", "few", "repeated", "empty"])
def test_op11(spark, tmp_path, kind):
    rows = clustered()
    rows = {"whole": rows, "few": rows[:9], "repeated": rows[:40] + rows[:20] + [(None, rows[3][1], None, "v", "r", "c")], "empty": []}[kind]
    assert coded(spark, tmp_path, rows) == codes_by_hand(rows)


def test_odd_vectors(spark, tmp_path):
    """Shorter vectors end in zeros, lengths are rounded up to the parts, components are held within reach."""
    rows = [(1, [1.0, 2.0, 3.0], 0), (2, [1.0, 2.0, 3.0, 0.0, 0.0, 0.0, 0.0], None), (3, [1e30, -1e30, 0.0, 0.0, 0.0, 0.0, 0.0], 1), (4, [], 1)]
    frame(spark, [(*r, "v", "r", "c") for r in rows]).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["vec_id"]: r for r in queries.QUERIES["op11_vector_codes"](spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3, 4} and got[1]["code"] == got[2]["code"] and {r["error"] for r in got.values()} == {0}
    whole = codes.Codes(frame(spark, [(*r, "v", "r", "c") for r in rows]))
    assert whole.width == 8 and max(abs(b).max() for b in whole.books) == reach(7)


@pytest.mark.parametrize("seed", range(4))
def test_balls(seed):
    draw = np.random.default_rng(seed)
    spread = [1, 30, 1000, 1 << 26][seed]
    entries = draw.integers(-spread, spread, (256, 4)) if seed else draw.integers(-1, 2, (256, 4))  # many equal entries
    entries[100:140] = entries[7]
    x = np.concatenate([draw.integers(-spread, spread + 1, (500, 4)), entries])
    tree = codes.Balls(entries, leaf=8)
    at, d = tree.nearest(x)
    whole = ((x[:, None].astype(object) - entries[None].astype(object)) ** 2).sum(2)
    assert d.tolist() == [min(r) for r in whole] and at.tolist() == [int(np.argmin(r)) for r in whole.astype(np.int64)]
    if seed > 1:
        assert tree.compared < len(x) * len(entries)  # balls are left out


def negatives_by_hand(rows, anchor=lambda i: i % 100 == 0):
    kept = [(r[0], (r[2] + 1) % 10 if r[0] % 7 == 0 else r[2], np.array([math.floor(256 * y) for y in r[1]])) for r in usable(rows) if r[2] is not None]
    out = []
    for k, (i, label, x) in enumerate(kept):
        if anchor(i):
            score = [int(x @ y) for _, _, y in kept]
            same = sorted((-score[j], kept[j][0]) for j in range(len(kept)) if j != k and kept[j][1] == label)[:5]
            for s, p in same:
                near = sorted((-score[j], kept[j][0]) for j in range(len(kept)) if kept[j][1] != label and 80 * -s <= 100 * score[j] <= 100 * -s)[:5]
                out += [(i, p, rank + 1, n, -s, -t) for rank, (t, n) in enumerate(near)]
    return sorted(out)


NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("kind", ["whole", "repeated", "no anchors", "empty"])
def test_op12(spark, tmp_path, kind):
    rows = clustered(640)
    rows = {"whole": rows, "repeated": rows[:220] + rows[95:105] + rows[200:210], "no anchors": rows[1:90], "empty": []}[kind]
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r[n] for n in NAMES) for r in queries.QUERIES["op12_hard_negatives"](spark, str(tmp_path)).collect())
    assert got == negatives_by_hand(rows) and (bool(got) or kind in ("no anchors", "empty"))


def test_negatives_without_ids(spark, tmp_path):
    """Rows without an id take part and come last among ties; rows without a label or a usable vector don't; vectors of several lengths end in zeros."""
    one, short = [1.0, 0.0, 0.0], [1.0]
    rows = [(100, one, 1), (None, short, 1), (3, one, 1), (None, one, 2), (5, [1.0, 0.0], 2), (6, one, None), (8, None, 2), (9, [None, 1.0], 2), (11, [], 3)]
    frame(spark, [(*r, "v", "r", "c") for r in rows]).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [tuple(r[n] for n in NAMES) for r in queries.QUERIES["op12_hard_negatives"](spark, str(tmp_path)).collect()]
    whole = 256 * 256
    assert sorted(got, key=str) == sorted([(100, p, k, n, whole, whole) for p in (3, None) for k, n in ((1, 5), (2, None))], key=str)


def test_small_groups_and_blocks(spark):
    """Many cells, groups of two anchors, blocks of a few rows: the same pairs, and rows that are left out of groups."""
    rows = [(r[0], r[1], r[2], *r[3:]) for r in clustered(640) if r[2] is not None]
    df = frame(spark, rows).withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    mined = negatives.HardNegatives(df, F.col("vec_id") % 20 == 0, pivots=24, group=2, block=50)
    got = sorted(tuple(r[n] for n in NAMES) for r in mined.pairs.collect())
    assert got == negatives_by_hand(rows, lambda i: i % 20 == 0)
    cells = [{"scope": 0, "cell": c, "n": 2, "far": 1.0, "inner": 0.0, "outer": 40.0} for c in range(len(mined.pivots.x))]
    groups = negatives.Groups(cells, mined.pivots, 2)
    x = mined.pivots.x.astype(np.int64)
    place, group = groups.of_rows(np.zeros(len(x), np.int64), mined.pivots.away(x))
    assert groups.count == len(x) and len(x) <= len(place) < len(x) ** 2  # each is in its own group, not in all


def test_cells_that_hold_too_many_anchors_are_split():
    pivots = negatives.Pivots(np.array([[0, 0], [9, 9]]), 200)
    groups = negatives.Groups([{"scope": 3, "cell": 0, "n": 70, "far": 1.0, "inner": 0.0, "outer": math.inf}, {"scope": 3, "cell": 1, "n": 5, "far": 1.0, "inner": 0.0, "outer": 0.5}], pivots, 10)
    low, high = groups.spans[3, 0]
    assert high - low + 1 == 7 and groups.count == 8
    place, group = groups.of_rows(np.array([3, 4]), pivots.away(np.array([[0, 0], [0, 0]])))
    assert set(group.tolist()) == set(range(low, high + 1)) and set(place.tolist()) == {0}


def test_firsts():
    draw = random.Random(1)
    row, score, rank = (np.array([draw.randrange(k) for _ in range(400)]) for k in (5, 4, 1000))
    got = negatives.firsts(row, score, rank, 3)
    for r in range(5):
        own = sorted((-score[k], rank[k]) for k in range(400) if row[k] == r)[:3]
        assert sorted((-score[k], rank[k]) for k in got if row[k] == r) == own
