"""MinHash near-duplicates by an inverted join on signature coordinates.

Every document gets one signature; documents with the same shingle set are one class from the start. The remaining class
representatives are posted under each (coordinate, value) pair. Two documents whose signatures agree in at least T of K
coordinates share a pair among the K-T+1 rarest pairs of both (the prefix), so only those are posted and merged; the longer lists
are skipped. Collisions are counted for each pair of documents that the merge meets, those of the skipped lists are added from both
signatures, and pairs with T or more are confirmed on the full shingle sets.

Which pairs the merge meets: each member of a list with the list's hub, the member whose signature is the most common; so a list
of n copies costs n pairs. Where a list's members lie in several components by then, members of different components meet: in
lists of SHORT members or fewer directly, in longer ones if they share one of the rarest shingles of their full sets, as two sets
of the similarity must. So no link between different components is lost.

Null and empty texts have no shingles and stay alone. Rows without an id stay alone and have no component. Ids are integers; rows
that share one each have the component of their own text. Nothing is collected; each round of components is written to the
checkpoint folder.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import bucketed, documents, durable, looked_up, slices

COORDINATES = 32
AGREE = 14  # at a similarity of 0.8, fewer of 32 agree once in about 800,000 pairs
SHORT = 16
CACHE_WORDS = 100_000
SLICE = 2 << 20  # bytes of text that a task turns into arrays at once


class Words(dict):
    """64-bit hashes of words, kept while there is room."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > CACHE_WORDS:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


@lru_cache(1)
def word_hashes() -> Words:
    return Words()


@lru_cache(4)
def multipliers(k: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20260)
    return draw.integers(0, 2**64, k, np.uint64) | np.uint64(1), draw.integers(0, 2**64, k, np.uint64)


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """The distinct shingles of a text, as sorted 64-bit hashes."""
    words = (text or b"").lower().split()  # of bytes: lower-cases A-Z only, and parts at ASCII white space
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(word_hashes().__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(out ^ (out >> np.uint64(32)))


def signature(found: np.ndarray, k: int) -> np.ndarray:
    """(coordinate, value) pairs as numbers: the coordinate above the 32 bits of the least hash."""
    a, b = multipliers(k)
    least = np.full(k, 2**64 - 1, np.uint64)
    for at in range(0, len(found), 4096):
        np.minimum(least, (found[at : at + 4096, None] * a + b).min(0), out=least)
    return (np.arange(k) << 32) | (least >> np.uint64(32)).astype(np.int64)


def features(df: DataFrame, id_col: str, text_col: str, size: int, k: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part, texts in slices(batch, 1, SLICE):
                n, digest, pairs = [], [], []
                for text in texts:
                    found = shingles(text, size)
                    n.append(len(found))
                    digest.append(blake2b(found.tobytes(), digest_size=16).digest())
                    pairs.append(signature(found, k) if len(found) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(pairs, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "pairs"])
        word_hashes().clear()

    return df.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, "doc_id bigint, n_shingles bigint, digest binary, pairs array<bigint>")


def sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """docs: doc_id, text; wanted: doc_id, digest, and more -> doc_id, found, and more: the shingle sets of the wanted rows. A row of the same id with another set isn't wanted."""
    more = [c for c in wanted.columns if c not in ("doc_id", "digest")]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part, texts in slices(batch, 1, SLICE):
                found = [shingles(t, size).view(np.int64) for t in texts]
                same = pa.array([blake2b(f.tobytes(), digest_size=16).digest() == d for f, d in zip(found, part.column(2).to_pylist(), strict=True)], pa.bool_())
                out = pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64())), *part.columns[3:]], ["doc_id", "found", *more])
                yield out.filter(same)
        word_hashes().clear()

    kinds = "".join(f", {c} {wanted.schema[c].dataType.simpleString()}" for c in more)
    return docs.join(wanted, "doc_id").select("doc_id", "text", "digest", *more).mapInArrow(run, f"doc_id bigint, found array<bigint>{kinds}")


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, root) for every linked node but the roots; root is the component's smallest node.

    Alternating large-star and small-star rounds; each uses minima, which combine before the shuffle, and joins whose skew
    Spark can split.
    """
    edges = durable(links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).where("node <> root").distinct(), "edges")
    state = None
    while True:
        both = edges.select("node", F.col("root").alias("other")).unionByName(edges.select(F.col("root").alias("node"), F.col("node").alias("other")))
        least = both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("m", "node").alias("m"))
        large = both.where("other > node").join(least, "node").select(F.col("other").alias("node"), F.col("m").alias("root")).distinct()
        low = large.groupBy("node").agg(F.min("root").alias("m"))
        small = large.join(low, "node").select(F.col("root").alias("node"), F.col("m").alias("root")).where("node <> root").unionByName(low.withColumnRenamed("m", "root"))
        edges = durable(small.distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        if now == state:
            return edges
        state = now


def rare_pairs(found: DataFrame, percent: int) -> DataFrame:
    """(doc_id, found, root) -> (a, b) of different roots that may have the similarity, each once.

    The pair has percent / (100 + percent) of both sizes' sum in common. In the order of rarity, the first shingle that both
    have must come so early that enough are left after it on both sides. The shingles that a copy has for itself come first,
    and so copies that differ too much never meet.
    """
    items = found.select("doc_id", "root", F.size("found").alias("size"), F.explode("found").alias("item"))
    shared = items.groupBy("item").agg(F.count("*").alias("n"), F.min("root").alias("x"), F.max("root").alias("y")).where("n > 1")
    own = items.join(shared, "item").groupBy("doc_id", "root", "size").agg(F.sort_array(F.collect_list(F.struct("n", "item", "x", "y"))).alias("own"))
    # left: shingles from this one on; those that nobody shares came before all of these
    posted = own.select("doc_id", "root", "size", F.size("own").alias("m"), F.posexplode("own").alias("k", "p")).select(
        "doc_id", "root", "size", (F.col("m") - F.col("k")).alias("left"), F.col("p.item").alias("item"), (F.col("p.x") != F.col("p.y")).alias("several")
    )
    posted = posted.where(F.col("several") & (100 * F.col("left") >= percent * F.col("size"))).drop("several")
    p, q = posted.alias("p"), posted.alias("q")
    enough = (100 + percent) * F.least("p.left", "q.left") >= percent * (F.col("p.size") + F.col("q.size"))
    met = (F.col("p.item") == F.col("q.item")) & (F.col("p.doc_id") < F.col("q.doc_id")) & (F.col("p.root") != F.col("q.root")) & enough
    return p.join(q, met).select(F.col("p.doc_id").alias("a"), F.col("q.doc_id").alias("b")).distinct()


def prefixes(reps: DataFrame, k: int, agree: int) -> DataFrame:
    """(rep, pairs) -> rep, known, pair: the pairs under which a document is posted, the rarest first. Pairs that are alone take room in it but lead nowhere."""
    posted = reps.select("rep", F.explode("pairs").alias("pair"))
    # as a table of its own, so that the join with a hot pair can be split
    shared = durable(posted.groupBy("pair").agg(F.count("*").alias("n")).where("n > 1"), "shared pairs")
    ordered = posted.join(shared, "pair").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "pair"))).alias("own"), F.sum("n").alias("known"))  # k at most
    prefix = F.slice("own", 1, F.greatest(F.lit(0), F.size("own") - (agree - 1)))
    return ordered.select("rep", "known", F.explode(prefix).alias("p")).select("rep", "known", F.col("p.pair").alias("pair"))


def agreeing(met: DataFrame, reps: DataFrame, k: int, agree: int) -> DataFrame:
    """(a, b), a row for each collision in the merged lists -> a, b with `agree` collisions or more in all lists."""
    counted = met.groupBy("a", "b").agg(F.count("*").alias("met"))
    x, y = (reps.select(F.col("rep").alias(c), F.col("pairs").alias(f"{c}_pairs")) for c in "ab")
    both = counted.join(x, "a").join(y, "b")
    return both.where((F.col("met") >= agree) | (F.size(F.array_intersect("a_pairs", "b_pairs")) >= agree)).select("a", "b")  # not made distinct: that would keep a hub's rows in one task


def confirmed(pairs: DataFrame, docs: DataFrame, names: DataFrame, size: int, percent: int, name: str) -> DataFrame:
    """(a, b) of `pairs` whose full sets have the similarity."""
    pairs = durable(pairs, f"{name} candidates")
    own = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    full = durable(sets(docs, own.join(names, "doc_id"), size), f"{name} sets")
    x, y = (full.select(F.col("doc_id").alias(c), F.col("found").alias(f"{c}_set")) for c in "ab")
    both = F.size(F.array_intersect("a_set", "b_set"))
    sizes = pairs.join(x, "a").join(y, "b").select("a", "b", both.alias("both"), (F.size("a_set") + F.size("b_set")).alias("sum"))
    return durable(sizes.where(F.expr(f"100L * both >= {percent}L * (sum - both)")).select("a", "b"), f"{name} links")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, k: int = COORDINATES, agree: int = AGREE) -> DataFrame:
    """A row for each row of df: doc_id, n_shingles, component_id, kept.

    Texts are linked if 100 * |A and B| >= percent * |A or B| for their sets of `size`-word shingles; component_id is the
    smallest id that links reach, kept whether that is the row's own.
    """
    # texts move once; what needs their sets later finds them by bucket
    docs = bucketed(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null"), ["doc_id"], "texts by id")
    every = durable(features(df, id_col, text_col, size, k), "signatures")
    real = every.where("n_shingles > 0 and doc_id is not null")
    # rows of one class have one set, and so one signature
    classes = durable(real.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("pairs").alias("pairs")), "classes")
    reps = classes.select("rep", "pairs")
    lists = durable(prefixes(reps, k, agree), "lists")

    hubs = lists.groupBy("pair").agg(F.max(F.struct("known", (-F.col("rep")).alias("rep"))).alias("hub"), F.count("*").alias("n")).where("n > 1").select("pair", "n", (-F.col("hub.rep")).alias("hub"))
    member = lists.select("rep", "pair").join(durable(hubs, "hubs"), "pair")
    star = agreeing(member.where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")), reps, k, agree)
    names = classes.select(F.col("rep").alias("doc_id"), "digest")
    first = confirmed(star, docs, names, size, percent, "hub")
    roots = components(first)

    labelled = member.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    mixed = labelled.groupBy("pair").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("pair")
    mixed = durable(mixed, "mixed lists")
    open_ = durable(labelled.join(mixed, "pair", "left_semi").select("pair", "n", "rep", "root"), "open lists")
    short = open_.where(F.col("n") <= SHORT).groupBy("pair").agg(F.collect_list(F.struct("rep", "root")).alias("m"))
    apart = F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: (y["rep"] > x["rep"]) & (y["root"] != x["root"])), lambda y: F.struct(x["rep"].alias("a"), y["rep"].alias("b")))))
    near = short.select(F.explode(apart).alias("p")).select("p.*")
    long = durable(open_.where(F.col("n") > SHORT).select(F.col("rep").alias("doc_id"), "root").distinct(), "members of long lists")
    if not long.isEmpty():
        full = durable(sets(docs, long.join(names, "doc_id"), size), "sets of long lists")
        near = near.unionByName(rare_pairs(full, percent))
    second = confirmed(agreeing(near, reps, k, agree), docs, names, size, percent, "other")
    if not second.isEmpty():
        roots = components(first.unionByName(second))

    named = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("digest", "n", F.coalesce("root", "rep").alias("root"))
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    whole = looked_up(every.select("doc_id", "n_shingles", "digest"), named, ["digest"], "n", total, (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    component = F.when(F.col("n_shingles") > 0, F.coalesce("root", "doc_id")).otherwise(F.col("doc_id"))
    return whole.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op7_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), size=4)
