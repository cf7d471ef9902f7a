"""Hard negatives by a distributed kNN join over Voronoi cells.

Vectors are integers, so scores (inner products) are exact. A component more, sqrt(M - |x|^2) with the largest |x|^2 as M, gives all
rows the same norm; anchors get a zero there. Then a higher score is a smaller distance, |q|^2 + M - 2 * score, and the triangle
inequality bounds what an anchor can need.

1. Pivots are a bounded number of rows; anchors belong to the cell of the nearest. Neighbouring cells are packed into groups, the
   cell with too many anchors is split into several.
2. Positives: the cells of an anchor's label, with their row counts and radii, bound the distance of its first `positives` rows. A
   row goes to the groups of its label (labels share a bounded number of scopes) that have a cell whose bound it meets.
3. Negatives: the scores asked for are now a ring around each anchor. A row goes to the groups with a cell whose ring it can meet.
4. A group's rows are dealt into blocks of bounded size; each block is joined exactly with the group's anchors (matrix products,
   integers compared), and the firsts of the blocks are merged.

Distances are floats, rounded by SLACK to the safe side; what is returned comes from integers. In what the joins hand on, only
anchors (not rows) meet with several positives, so nothing grows with the size of a hot label or of a group of copies but the rows
that its groups must see anyway.

Rows without a label, vector or finite components take no part; components are held within vectors.reach(); shorter vectors end in
zeros. Rows with equal ids are rows of their own, and an anchor's "other rows" are all but itself; a null id comes last among ties.
Labels of any type are compared as strings. An empty table, or one without anchors, gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import durable, looked_up
from tidewell.llm.vectors import fitting, integer_rows, matrix

POSITIVES, NEGATIVES, LEAST, MOST, SCALE = 5, 5, 80, 100, 256
PIVOTS, SCOPES = 64, 64  # cells; scopes that labels are hashed into
ANCHORS, BLOCK = 8192, 32768  # of a group, and rows of a block
CELLS = 1 << 21  # scores that are held at once
SLACK = 1e-6
LAST = (1 << 63) - 1  # stands for a null id


class Pivots:
    """A bounded number of rows in an order in which neighbours are near each other."""

    def __init__(self, vectors: np.ndarray, top: int):
        x = np.unique(vectors, axis=0)
        left, order = list(range(1, len(x))), [0][: len(x)]
        while left:
            d = ((x[left].astype(np.float64) - x[order[-1]]) ** 2).sum(1)
            order.append(left.pop(int(np.argmin(d))))
        self.x = x[order].astype(np.float64)
        self.top = float(top)
        self.slack = SLACK * (1 + math.sqrt(top))
        self.more = np.sqrt(np.maximum(0, top - (self.x**2).sum(1)))

    def away(self, x: np.ndarray, anchors: bool = False) -> np.ndarray:
        """Distances to the pivots, of rows or of anchors."""
        x = x.astype(np.float64)
        norm = (x * x).sum(1)
        more = np.zeros(len(x)) if anchors else np.sqrt(np.maximum(0, self.top - norm))
        return np.sqrt(np.maximum(0, (norm + more**2)[:, None] + self.top - 2 * (x @ self.x.T + more[:, None] * self.more)))


def firsts(row: np.ndarray, score: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each row, by score from the top, then by rank."""
    order = np.lexsort((rank, -score, row))
    at = row[order]
    begin = np.concatenate([[0], np.nonzero(np.diff(at))[0] + 1]) if len(at) else np.zeros(0, np.int64)
    place = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
    return order[place < k]


def scores(anchors: np.ndarray, rows: np.ndarray):
    """(first anchor, exact scores) for slices of the anchors, of CELLS scores at most."""
    a, b = fitting(anchors, rows)
    step = max(1, CELLS // max(1, len(rows)))
    for k in range(0, len(a), step):
        yield k, (a[k : k + step] @ b.T).astype(np.int64)


class Groups:
    """Which anchors' groups a row may serve. cells: a row for each scope and cell that has anchors."""

    def __init__(self, cells: list, pivots: Pivots, size: int):
        self.pivots, self.scopes, at = pivots, {}, 0
        total = sum(c["n"] for c in cells)
        size = max(1, min(size, -(-total // 4)))
        for c in sorted(cells, key=lambda c: (c["scope"], c["cell"])):
            own = self.scopes.setdefault(c["scope"], {"cell": [], "low": [], "high": [], "far": [], "inner": [], "outer": [], "sum": 0, "base": at})
            low = own["base"] + own["sum"] // size
            own["sum"] += c["n"]
            high = own["base"] + (own["sum"] - 1) // size
            for k, v in (("cell", c["cell"]), ("low", low), ("high", high), ("far", c["far"]), ("inner", c["inner"]), ("outer", c["outer"])):
                own[k].append(v)
            at = high + 1
        self.count = at
        self.spans = {(s, c): (a, b) for s, own in self.scopes.items() for c, a, b in zip(own["cell"], own["low"], own["high"], strict=True)}

    def of_rows(self, scope: np.ndarray, away: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the row, group), a pair for each group that the row may serve."""
        places, groups = [], []
        for s in np.unique(scope):
            if int(s) not in self.scopes:
                continue
            own, rows = self.scopes[int(s)], np.nonzero(scope == s)[0]
            far, slack = np.array(own["far"]), self.pivots.slack
            d = away[rows][:, own["cell"]]
            meets = (d - far <= np.array(own["outer"]) + slack) & (d + far >= np.array(own["inner"]) - slack)
            served = np.zeros((len(rows), own["high"][-1] - own["base"] + 1), bool)
            for k in range(meets.shape[1]):
                served[:, own["low"][k] - own["base"] : own["high"][k] - own["base"] + 1] |= meets[:, [k]]
            r, g = np.nonzero(served)
            places.append(rows[r])
            groups.append(g + own["base"])
        return (np.concatenate(places), np.concatenate(groups)) if places else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class HardNegatives:
    """pairs: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""

    def __init__(self, df: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: float = SCALE,
                 positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, pivots: int = PIVOTS, group: int = ANCHORS, block: int = BLOCK):
        self.positives, self.negatives, self.least, self.most, self.group, self.block = positives, negatives, least, most, group, block
        columns = {"vec_id": F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)), "label": F.col(label_col).cast("string"), "anchor": F.coalesce(anchors, F.lit(False))}
        self.rows = integer_rows(df.where(F.col(label_col).isNotNull()), columns, vector_col, scale, "mined vectors").withColumn("scope", F.pmod(F.xxhash64("label"), F.lit(SCOPES)).cast("int"))
        found = self.rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.max("norm").alias("top")).first()
        self.n, self.width = found["n"], found["width"] or 0
        self.parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        chosen = [r["v"] for r in self.rows.orderBy(F.xxhash64("row"), "row").limit(pivots).select("v").collect()]
        whole = np.zeros((len(chosen), self.width), np.int64)
        for k, v in enumerate(chosen):
            whole[k, : len(v)] = v
        self.pivots = Pivots(whole, found["top"] or 0)

    def label_cells(self) -> DataFrame:
        """label, n (its rows) and cells: n and radius of each cell that has rows of the label."""
        pivots, width = self.pivots, self.width

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                away = pivots.away(matrix(batch.column(1), width))
                cell = away.argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell.astype(np.int32)), pa.array(away[np.arange(len(cell)), cell])], ["label", "cell", "far"])

        each = self.rows.select("label", "v").mapInArrow(run, "label string, cell int, far double").groupBy("label", "cell").agg(F.count("*").alias("n"), F.max("far").alias("far"))
        return each.groupBy("label").agg(F.sum("n").alias("n"), F.collect_list(F.struct("cell", "n", "far")).alias("cells"))  # PIVOTS cells at most

    def with_bounds(self, anchors: DataFrame) -> DataFrame:
        """Anchors with the distance within which their first positives lie (outer) and their cell."""
        pivots, width, k = self.pivots, self.width, self.positives + 1  # one may be the anchor

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                away = pivots.away(matrix(batch.column(3), width), anchors=True)
                cell, outer = away.argmin(1), np.full(len(away), np.inf)
                for r, cells in enumerate(batch.column(5).to_pylist()):
                    reached = 0
                    for bound, n in sorted((away[r, c["cell"]] + c["far"], c["n"]) for c in cells or []):
                        reached += n
                        if reached >= k:
                            outer[r] = bound + 2 * pivots.slack
                            break
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(cell.astype(np.int32)), pa.array(away[np.arange(len(cell)), cell]), pa.array(np.zeros(len(cell))), pa.array(outer)], names)

        cells = durable(self.label_cells(), "cells of labels")
        known = looked_up(anchors, cells, ["label"], "n", self.n).select("row", "vec_id", "label", "v", "scope", "cells")
        names = ["row", "vec_id", "label", "v", "scope", "cell", "away", "inner", "outer"]
        return known.mapInArrow(run, "row bigint, vec_id bigint, label string, v array<int>, scope int, cell int, away double, inner double, outer double")

    def with_rings(self, anchors: DataFrame) -> DataFrame:
        """Anchors (with `found`, their positives) with the ring of the scores asked for and their cell."""
        pivots, width, least, most = self.pivots, self.width, self.least / 100, self.most / 100

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                x = matrix(batch.column(3), width)
                away, norm = pivots.away(x, anchors=True), (x * x).sum(1).astype(np.float64) + pivots.top
                cell = away.argmin(1)
                own = [[p["score"] for p in f if p["score"] >= 0] for f in batch.column(4).to_pylist()]
                low, high = (np.array([f(s) for s in own], np.float64) for f in (min, max))
                inner, outer = (np.sqrt(np.maximum(0, norm - 2 * s)) for s in (most * high, least * low))
                places = [pa.array(cell.astype(np.int32)), pa.array(away[np.arange(len(cell)), cell]), pa.array(inner - pivots.slack), pa.array(outer + pivots.slack)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(np.zeros(len(cell), np.int32)), *places], names)

        names = ["row", "vec_id", "label", "v", "found", "scope", "cell", "away", "inner", "outer"]
        some = anchors.where(F.exists("found", lambda p: p["score"] >= 0)).select("row", "vec_id", "label", "v", "found")  # no score lies between 80 % and 100 % of a negative one
        return some.mapInArrow(run, "row bigint, vec_id bigint, label string, v array<int>, found array<struct<rank:int,id:bigint,score:bigint>>, scope int, cell int, away double, inner double, outer double")

    def blocks(self, anchors: DataFrame, scoped: bool):
        """Anchors and rows by group and block, ready to be joined."""
        cells = anchors.groupBy("scope", "cell").agg(F.count("*").alias("n"), F.max("away").alias("far"), F.min("inner").alias("inner"), F.max("outer").alias("outer")).collect()  # SCOPES x PIVOTS at most
        groups, pivots, width = Groups(cells, self.pivots, self.group), self.pivots, self.width
        shards = max(1, -(-self.n // self.block), -(-4 * self.parts // max(1, groups.count)))
        spans, most = groups.spans, shards

        def dealt(batches):
            import pyarrow as pa

            for batch in batches:
                x = matrix(batch.column(3), width)
                scope = batch.column(4).to_numpy() if scoped else np.zeros(batch.num_rows, np.int32)
                place, group = groups.of_rows(scope, pivots.away(x))
                shard = batch.column(0).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                for a in range(0, len(place), 8192):
                    p = place[a : a + 8192]
                    part = batch.take(pa.array(p))
                    yield pa.RecordBatch.from_arrays([pa.array(group[a : a + 8192].astype(np.int32)), pa.array((shard[p] % np.uint64(most)).astype(np.int32)), *part.columns[:4]], ["group", "shard", "row", "vec_id", "label", "v"])

        rows = self.rows.select("row", "vec_id", "label", "v", "scope").mapInArrow(dealt, "group int, shard int, row bigint, vec_id bigint, label string, v array<int>")
        many = len(self.pivots.x)
        low, high = (F.create_map(*(F.lit(y) for (s, c), v in spans.items() for y in (s * many + c, v[k])))[F.col("scope") * many + F.col("cell")] if spans else F.lit(0) for k in (0, 1))
        own = anchors.withColumn("group", (low + F.pmod(F.xxhash64("row"), high - low + 1)).cast("int"))
        own = own.drop("scope", "cell", "away", "inner", "outer").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        return own.groupBy("group", "shard"), rows.groupBy("group", "shard")

    def found(self, anchors: DataFrame) -> DataFrame:
        """anchor (its row), rank, id, score: the first rows of the anchor's own label."""
        width, k = self.width, self.positives

        def joined(own, rows):
            import pyarrow as pa

            rows = rows.sort_by([("vec_id", "ascending"), ("row", "ascending")])
            out: list = [[], [], []]
            if own.num_rows and rows.num_rows:
                label = pa.chunked_array([*own["label"].chunks, *rows["label"].chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
                mine, theirs = label[: own.num_rows], label[own.num_rows :]
                self_, row, ids = own["row"].to_numpy(), rows["row"].to_numpy(), rows["vec_id"].to_numpy()
                for a, s in scores(matrix(own["v"], width), matrix(rows["v"], width)):
                    b = a + len(s)
                    at, col = np.nonzero((mine[a:b, None] == theirs) & (self_[a:b, None] != row))
                    keep = firsts(at, s[at, col], col, k)
                    for o, x in zip(out, (self_[a + at[keep]], ids[col[keep]], s[at[keep], col[keep]]), strict=True):
                        o.append(x)
            return pa.table([pa.array(np.concatenate(o) if o else np.zeros(0, np.int64)) for o in out], ["anchor", "id", "score"])

        own, rows = self.blocks(anchors, True)
        each = own.cogroup(rows).applyInArrow(joined, "anchor bigint, id bigint, score bigint")
        order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
        return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    @property
    def pairs(self) -> DataFrame:
        width, k, least, most = self.width, self.negatives, self.least, self.most

        def joined(own, rows):
            import pyarrow as pa

            rows = rows.sort_by([("vec_id", "ascending"), ("row", "ascending")])
            out: list = [[] for _ in range(6)]
            if own.num_rows and rows.num_rows:
                label = pa.chunked_array([*own["label"].chunks, *rows["label"].chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
                mine, theirs, ids = label[: own.num_rows], label[own.num_rows :], rows["vec_id"].to_numpy()
                self_, name, lists = own["row"].to_numpy(), own["vec_id"].to_numpy(), own["found"].to_pylist()
                asked = [[p["score"] for p in f if p["score"] >= 0] for f in lists]
                low, high = (np.array([f(s) for s in asked], np.int64) for f in (min, max))
                for a, s in scores(matrix(own["v"], width), matrix(rows["v"], width)):
                    b = a + len(s)
                    at, col = np.nonzero((mine[a:b, None] != theirs) & (100 * s >= least * low[a:b, None]) & (100 * s <= most * high[a:b, None]))
                    score = s[at, col]
                    for place in range(max(map(len, lists[a:b]))):
                        own_p = np.array([f[place]["score"] if place < len(f) else -1 for f in lists[a:b]], np.int64)
                        p = own_p[at]
                        some = np.nonzero((p >= 0) & (least * p <= 100 * score) & (100 * score <= most * p))[0]
                        some = some[firsts(at[some], score[some], col[some], k)]
                        r = a + at[some]
                        positive = np.array([f[place]["id"] if place < len(f) else -1 for f in lists[a:b]], np.int64)[at[some]]
                        for o, x in zip(out, (self_[r], np.full(len(r), place), name[r], positive, p[some], np.stack([ids[col[some]], score[some]], 1)), strict=True):
                            o.append(x)
            flat = [np.concatenate(o) if o else np.zeros(0, np.int64) for o in out[:5]]
            last = np.concatenate(out[5]) if out[5] else np.zeros((0, 2), np.int64)
            return pa.table([pa.array(x) for x in (*flat, last[:, 0].copy(), last[:, 1].copy())], ["anchor", "place", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

        anchors = durable(self.with_bounds(self.rows.where("anchor").select("row", "vec_id", "label", "v", "scope")), "anchors")
        found = self.found(anchors).groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("found"))
        ringed = durable(self.with_rings(anchors.select("row", "vec_id", "label", "v").join(found, F.col("row") == F.col("anchor"))), "anchors with positives")
        own, rows = self.blocks(ringed, False)
        each = own.cogroup(rows).applyInArrow(joined, "anchor bigint, place bigint, anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint")
        order = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id")
        ranked = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        ids = {c: F.nullif(F.col(c), F.lit(LAST)).alias(c) for c in ("anchor_id", "positive_id", "negative_id")}
        return ranked.select(ids["anchor_id"], ids["positive_id"], "rank", ids["negative_id"], "positive_score", "negative_score")


def hard_negatives(df: DataFrame, anchors: Column, **options) -> DataFrame:
    return HardNegatives(df, anchors, **options).pairs


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    noisy = df.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(noisy, F.col("vec_id") % 100 == 0)


OP12_SQL = f"""
WITH k AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM k a JOIN k b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score
  FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {POSITIVES}
)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id))::INT AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND {LEAST} * positive_score <= 100 * score AND 100 * score <= {MOST} * positive_score
QUALIFY rank <= {NEGATIVES}
"""
