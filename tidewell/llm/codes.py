"""Vectors as short codes: a codebook for each part of the vector, the nearest entry found by a ball tree.

Components become integers, so every sum and every distance is exact, and any partitioning gives the same codes. A pass over the
vectors adds up the parts of each entry within its task; the sums of the tasks meet in one grouping by entry and position. Codebooks
(entries x components) are all that reaches the driver.

Within a task a ball tree holds the entries of a part position. Its centres are entries, so distances to them are exact integers;
radii and square roots are rounded outwards, and a ball is entered when its bound is not above the best distance so far, equality
included. What decides is the integer distance, then the lower index.

Null vectors and those with null or non-finite components leave their row out. Shorter vectors than the longest end in zeros, as all
do where the length is no multiple of the parts. Components are held within vectors.reach(). Rows may repeat; a null id comes last in
the choice of first entries. An empty table gives no rows.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import durable, looked_up
from tidewell.llm.vectors import fitting, integer_rows, matrix, squared

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LEAF = 16
ROWS = 8192  # vectors that a task looks up together
OUT = 1 + 1e-9  # bounds are rounded outwards by this factor


class Balls:
    """A ball tree over the rows of `entries`; nearest() gives the same as comparing with each of them."""

    def __init__(self, entries: np.ndarray, leaf: int = LEAF):
        self.entries, self.leaf = entries, leaf
        self.nodes: list[tuple] = []  # centre, radius, members, left and right (-1: none)
        self.compared = 0
        if len(entries):
            self.build(np.arange(len(entries)))

    def build(self, members: np.ndarray) -> int:
        e = self.entries[members].astype(np.float64)
        centre = members[int(np.argmin(((e - e.mean(0)) ** 2).sum(1)))]
        d = squared(*fitting(self.entries[members], self.entries[[centre]]))[:, 0].astype(np.float64)
        at, far = len(self.nodes), int(np.argmax(d))
        self.nodes.append((int(centre), float(np.sqrt(d[far])) * OUT, members, -1, -1))
        if len(members) > self.leaf and d[far]:
            other = int(np.argmax(((e - e[far]) ** 2).sum(1)))
            order = np.argsort(((e - e[far]) ** 2).sum(1) - ((e - e[other]) ** 2).sum(1), kind="stable")
            half = len(members) // 2
            self.nodes[at] = (*self.nodes[at][:3], self.build(members[order[:half]]), self.build(members[order[half:]]))
        return at

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, squared distance) for each row; the lower index wins a tie."""
        x, entries = fitting(x, self.entries)
        xx, ee = (x * x).sum(1), (entries * entries).sum(1)
        best, at = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(entries))

        def to(rows, columns):
            self.compared += len(rows) * len(columns)
            return (xx[rows, None] + ee[columns] - 2 * (x[rows] @ entries[columns].T)).astype(np.int64)

        def visit(node: int, rows: np.ndarray) -> None:
            _, _, members, left, right = self.nodes[node]
            if left < 0:
                members = np.sort(members)
                d = to(rows, members)
                k = d.argmin(1)  # the first of equals, and so the lowest index
                d, found = d[np.arange(len(rows)), k], members[k]
                better = (d < best[rows]) | (d == best[rows]) & (found < at[rows])
                best[rows[better]], at[rows[better]] = d[better], found[better]
                return
            away = np.sqrt(to(rows, np.array([self.nodes[left][0], self.nodes[right][0]])).astype(np.float64))
            first = away[:, 0] <= away[:, 1]
            bound = np.maximum(0, away / OUT - [self.nodes[left][1], self.nodes[right][1]])
            for side, own in ((left, first), (right, ~first)):
                if own.any():
                    visit(side, rows[own])
            for side, own in ((right, first), (left, ~first)):
                own = own & (bound[:, int(side == right)] <= np.sqrt(best[rows].astype(np.float64)) * OUT)
                if own.any():
                    visit(side, rows[own])

        if len(entries) and len(x):
            visit(0, np.arange(len(x)))
        return at, best


def looked(batches, trees: list[Balls], width: int, column: int):
    """(part of a batch, its components, codes, squared distances) for ROWS vectors at a time; the last three by part position."""
    own = width // len(trees)
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            part = batch.slice(a, ROWS)
            x = matrix(part.column(column), width)
            cut = [x[:, k * own : (k + 1) * own] for k in range(len(trees))]
            found = [t.nearest(y) for t, y in zip(trees, cut, strict=True)]
            yield part, cut, [f[0] for f in found], [f[1] for f in found]


def round_of(rows: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """The codebooks after one round: each entry the floor of its parts' mean, unused entries as they were."""
    own = width // len(books)

    def run(batches):
        import pyarrow as pa

        trees = [Balls(b) for b in books]
        n, sums = np.zeros((len(books), len(books[0])), np.int64), np.zeros((len(books), len(books[0]), own), np.int64)
        for _, cut, codes, _ in looked(batches, trees, width, 0):
            for k, (x, c) in enumerate(zip(cut, codes, strict=True)):
                order = np.argsort(c, kind="stable")
                used, first = np.unique(c[order], return_index=True)
                n[k] += np.bincount(c, minlength=len(n[k]))
                if own:
                    sums[k, used] += np.add.reduceat(x[order], first)
        part, entry = np.nonzero(n)
        flat = sums[part, entry]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * own), pa.array(flat.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(n[part, entry]), lists], ["part", "entry", "n", "sums"])

    told = rows.select("v").mapInArrow(run, "part int, entry int, n bigint, sums array<bigint>")
    each = told.select("part", "entry", "n", F.posexplode("sums").alias("place", "x")).groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    out = [b.copy() for b in books]
    for r in each.collect():  # a row for each component of the codebooks
        out[r["part"]][r["entry"], r["place"]] = r["x"] // r["n"]
    return out


class Codes:
    """books: the codebooks, by part position; coded: vec_id, label, code, error of each row kept."""

    def __init__(self, df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE):
        if not 1 <= entries <= 256:
            raise ValueError("a code of a part has two hexadecimal digits: 1 to 256 entries")
        self.rows = integer_rows(df, {"vec_id": F.col(id_col), "label": F.col(label_col)}, vector_col, scale, "code vectors")
        longest = self.rows.agg(F.max(F.size("v"))).first()[0] or 0
        self.width, self.parts = -(-longest // parts) * parts, parts
        first = [r["v"] for r in self.rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()]
        whole = np.zeros((len(first), self.width), np.int64)
        for k, v in enumerate(first):
            whole[k, : len(v)] = v
        self.books = np.split(whole, parts, axis=1)
        for _ in range(rounds if first else 0):
            self.books = round_of(self.rows, self.books, self.width)

    @property
    def digest(self) -> str:
        return sha256(",".join(str(x) for b in self.books for x in b.ravel().tolist()).encode()).hexdigest()

    @property
    def coded(self) -> DataFrame:
        books, width = self.books, self.width
        label = self.rows.schema["label"].dataType.simpleString()

        def run(batches):
            import pyarrow as pa

            trees = [Balls(b) for b in books]
            for part, _, codes, errors in looked(batches, trees, width, 2):
                code = np.stack(codes, 1).astype(np.uint8).tobytes().hex()
                step = 2 * len(codes)
                code = [code[k : k + step] for k in range(0, len(code), step)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(code, pa.string()), pa.array(np.sum(errors, 0).astype(np.int64))], ["vec_id", "label", "code", "error"])

        kind = self.rows.schema["vec_id"].dataType.simpleString()
        return self.rows.select("vec_id", "label", "v").mapInArrow(run, f"vec_id {kind}, label {label}, code string, error bigint")


def with_label_errors(coded: DataFrame) -> DataFrame:
    """coded with label_error: the error of all rows with the same label, nulls together; null beyond 64 bits."""
    coded = durable(coded.withColumn("_label", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))), "codes")
    sums = durable(coded.groupBy("_label").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("_n")), "errors by label")
    total = sums.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    return looked_up(coded, sums, ["_label"], "_n", total).drop("_label", "_n")


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    codes = Codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return with_label_errors(codes.coded).select("vec_id", "code", "error", "label_error", F.lit(codes.digest).alias("codebooks_sha256"))


def sql(rounds: int = ROUNDS, parts: int = PARTS, width: int = 64) -> str:
    own = width // parts
    steps = [
        f"k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT vec_id, label, j, v[j * {own} + 1 : (j + 1) * {own}] AS x FROM k, range({parts}) r(j))",
        f"b0 AS MATERIALIZED (SELECT j, (row_number() OVER (PARTITION BY j ORDER BY vec_id)) - 1 AS e, x AS y FROM p QUALIFY e < {ENTRIES})",
    ]
    d = "list_inner_product(x, x) + list_inner_product(y, y) - 2 * list_inner_product(x, y)"
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT vec_id, label, j, x, min({{'d': {d}, 'e': e}}) AS m FROM p JOIN b{k} USING (j) GROUP BY ALL)")
        if k < rounds:
            steps.append(f"s{k} AS (SELECT j, m.e AS e, i, floor(sum(x[i]) / count(*)) AS y FROM a{k}, range(1, {own} + 1) r(i) GROUP BY ALL)")
            steps.append(f"n{k} AS (SELECT j, e, list(y ORDER BY i) AS z FROM s{k} GROUP BY ALL)")
            steps.append(f"b{k + 1} AS MATERIALIZED (SELECT j, e, coalesce(z, y) AS y FROM b{k} LEFT JOIN n{k} USING (j, e))")
    steps += [
        f"h AS (SELECT sha256(string_agg(array_to_string(list_transform(y, lambda c: c::BIGINT::VARCHAR), ','), ',' ORDER BY j, e)) AS codebooks_sha256 FROM b{rounds})",
        f"c AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', m.e::INT), '' ORDER BY j) AS code, sum(m.d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)",
    ]
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c, h"


OP11_SQL = sql()
