"""Scoring texts with a log-bilinear neural language model.

Training tokens are counted over the whole corpus: words, and pairs of neighbouring classes. The most frequent words are a class
each; every other word belongs to the class of its last three bytes. So the table of pairs is of bounded size, however large the
corpus and its vocabulary are, and no word is without a class. The log-bilinear model s(h, w) = (C r_h) q_w + b_w is trained on
that table in numpy by noise-contrastive estimation, in its exact expectation over the noise. Batched matrix products and a sum
over all classes give normalised log-probabilities; inside a class words follow their smoothed counts.

Counts of the most frequent words (HEAD at most) go to the tasks; those of all others are joined. Null and empty texts have one
token, the end. Rows without an id are held out. Repeated rows are scored each. With nothing to train on all classes are as
likely.
"""

from __future__ import annotations

from collections import Counter
from itertools import repeat
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import documents, durable, slices, utf8

HEAD = 150_000
CLASSES = 1024
ENDINGS = 640  # of the classes, those of words by their last bytes
TAIL = 3
CACHE_WORDS = 100_000
SIZE, NOISE, ROUNDS = 32, 10, 120
ADD = 0.1
END = b""
FLUSH_WORDS = 200_000


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()  # of bytes: A-Z only, ASCII white space only


def count_words(texts: DataFrame) -> DataFrame:
    """(text) -> word, n; the end of a text is the empty word."""

    def run(batches):
        import pyarrow as pa

        found: Counter = Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            found[END] += batch.num_rows
            for text in utf8(batch.column(0)):
                found.update(words_of(text))
                if len(found) > FLUSH_WORDS:
                    yield flush()
                    found.clear()
        yield flush()

    return texts.mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Kinds(dict):
    """word -> class: 0 the end, 1 to ENDINGS by the last bytes, then the most frequent words; looked-up words are kept while there is room."""

    def __init__(self, few: dict[bytes, int]):
        super().__init__(few)
        self.few = few

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
            self.update(self.few)
        out = self[word] = self.few.get(word) or ending(word)
        return out


def ending(word: bytes) -> int:
    return 1 + crc32(word[-TAIL:]) % ENDINGS


def ending_column(word: str):
    return 1 + F.crc32(F.substring(word, -TAIL, TAIL)) % ENDINGS


def count_pairs(texts: DataFrame, number: dict[bytes, int], classes: int) -> DataFrame:
    """(text) -> cell, n: how often class cell % classes follows class cell // classes; a text begins after an end."""
    shared = texts.sparkSession.sparkContext.broadcast(number)

    def run(batches):
        import pyarrow as pa

        get, total = Kinds(shared.value).__getitem__, np.zeros(classes * classes, np.int64)
        for batch in batches:
            for _, part in slices(batch, 0):
                rows = [np.fromiter(map(get, words), np.int64, len(words)) for words in map(words_of, part)]
                path = np.concatenate([x for own in rows for x in ([0], own)] + [[0]])  # texts share the ends between them
                total += np.bincount(path[:-1] * classes + path[1:], minlength=len(total))
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], ["cell", "n"])

    return texts.mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))


class LogBilinear:
    """Classes in, classes out."""

    def __init__(self, classes: int, size: int = SIZE, seed: int = 0):
        draw = np.random.default_rng(seed)
        self.r, self.q = draw.normal(0, 0.1, (classes, size)), draw.normal(0, 0.1, (classes, size))
        self.c, self.b = np.eye(size), np.full(classes, -np.log(classes))

    def fit(self, pairs: np.ndarray, noise: int = NOISE, rounds: int = ROUNDS, rate: float = 0.05) -> None:
        """pairs[h, w]: how often w follows h. Maximises the expected log-likelihood of telling data from `noise` draws of the unigram distribution each."""
        seen = pairs.sum(1, keepdims=True)
        total = max(1.0, seen.sum())
        unigram = (pairs.sum(0) + 0.5) / (pairs.sum() + 0.5 * len(pairs))
        self.b = np.log(unigram)
        data, fake, offset = pairs / total, seen / total * noise * unigram, np.log(noise * unigram)
        own = [self.r, self.q, self.c, self.b]
        first, second = [np.zeros_like(x) for x in own], [np.zeros_like(x) for x in own]
        for turn in range(1, rounds + 1):
            ahead = self.r @ self.c.T
            right = 1 / (1 + np.exp(-np.clip(ahead @ self.q.T + self.b - offset, -30, 30)))
            pull = data * (1 - right) - fake * right
            back = pull @ self.q
            for x, g, m, v in zip(own, [back @ self.c, pull.T @ ahead, back.T @ self.r, pull.sum(0)], first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                x += rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-12)
            if turn == rounds * 2 // 3:
                rate /= 4

    def log10(self, batch: int = 256) -> np.ndarray:
        """log10 of P(w | h) of all h and w: each row's probabilities sum to 1."""
        rows = []
        for at in range(0, len(self.r), batch):
            s = (self.r[at : at + batch] @ self.c.T) @ self.q.T + self.b
            s -= s.max(1, keepdims=True)
            rows.append(s - np.log(np.exp(s).sum(1, keepdims=True)))
        return np.concatenate(rows) / np.log(10)


def head_count(counts: DataFrame, most: int) -> int:
    """The least count such that at most `most` words have it: from a histogram of counts by eighths of a power of two, so a few hundred rows."""
    band = F.floor(F.log2("n") * 8)
    out, seen = 2**63 - 1, 0
    for row in counts.groupBy(band.alias("band")).agg(F.count("*").alias("words"), F.min("n").alias("least")).orderBy(F.desc("band")).collect():
        seen += row["words"]
        if seen > most:
            break
        out = row["least"]
    return out


class Model:
    """What scoring needs. counts: the durable table of all words; head: the most frequent ones, in order."""

    def __init__(self, texts: DataFrame, classes: int = CLASSES, head: int = HEAD):
        self.counts = durable(count_words(texts), "word counts")
        total = self.counts.agg(F.sum("n"), F.count("*")).first()
        self.tokens, self.distinct = total[0] or 0, total[1]
        real = self.counts.where(F.length("word") > 0)
        ends = self.counts.where(F.length("word") == 0).first()
        self.least = head_count(real, head)
        top = real.where(F.col("n") >= self.least).toArrow()  # at most `head` rows
        top = sorted(zip(top.column("n").to_pylist(), utf8(top.column("word")), strict=True), key=lambda r: (-r[0], r[1]))
        self.words = [w for _, w in top]
        self.n = np.array([n for n, _ in top], np.int64)
        self.ends = ends["n"] if ends else 0
        few = self.words[: max(0, classes - 1 - ENDINGS)]
        self.number = {w: k + 1 + ENDINGS for k, w in enumerate(few)}
        size = len(few) + 1 + ENDINGS
        cells = count_pairs(texts, self.number, size).toPandas()  # size * size at most
        pairs = np.zeros(size * size)
        pairs[cells["cell"].to_numpy(np.int64)] = cells["n"]
        model = LogBilinear(size)
        if self.tokens:
            model.fit(pairs.reshape(size, size))
        self.table = model.log10().astype(np.float32)
        self.base_of = self.tokens + ADD * (self.distinct + 1)
        # tokens and words of each class of endings, without the words that are classes themselves; one word more stands for new ones
        words, kinds = np.zeros(ENDINGS + 1), np.ones(ENDINGS + 1)
        for row in real.groupBy(ending_column("word").alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
            words[row["k"]], kinds[row["k"]] = row["n"], row["words"] + 1
        for w, n in zip(few, self.n.tolist(), strict=False):
            words[ending(w)] -= n
            kinds[ending(w)] -= 1
        self.rest_of = words + ADD * kinds

    @property
    def rare(self) -> DataFrame:
        """Words beyond the head, with their counts."""
        return self.counts.where((F.length("word") > 0) & (F.col("n") < self.least))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of df: doc_id, n_tokens, n_known, base_score, score."""
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    words, few = model.words, len(model.number)
    kinds = np.array([k + 1 + ENDINGS if k < few else ending(w) for k, w in enumerate(words)], np.int64)
    inside = np.where(np.arange(len(words)) < few, 0.0, np.log10((model.n + ADD) / model.rest_of[np.minimum(kinds, ENDINGS)]))
    shared = spark.sparkContext.broadcast((words, kinds, model.table, np.log10((model.n + ADD) / model.base_of), inside, np.log10((model.ends + ADD) / model.base_of), model.ends > 0))

    def run(batches):
        import pyarrow as pa

        words, kinds, table, base, inside, end, ends = shared.value
        get = {w: k for k, w in enumerate(words)}.get
        base, inside, kinds = np.append(base, 0.0), np.append(inside, 0.0), np.append(kinds, 0)  # last: rare words, scored by the join
        tails = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())]))
        for batch in batches:
            for part, texts in slices(batch, 1):
                rows = []
                for text in texts:
                    own = words_of(text)
                    ids = np.fromiter(map(get, own, repeat(-1)), np.int64, len(own))
                    path = kinds[ids]
                    rare = np.flatnonzero(ids < 0).tolist()
                    path[rare] = [ending(own[k]) for k in rare]
                    known = table[np.append(0, path), np.append(path, 0)].sum(dtype=np.float64)
                    missing = Counter([own[k] for k in rare])
                    rows.append((len(own) + 1, len(own) - missing.total() + ends, base[ids].sum() + end, known + inside[ids].sum(), [{"word": w, "n": n} for w, n in missing.items()]))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.float64(), pa.float64(), tails], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "n_tokens", "n_known", "base_score", "score", "tails"])

    read = df.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, n_known bigint, base_score double, score double, tails array<struct<word:binary,n:int>>")
    whole = durable(read.withColumn("row", F.monotonically_increasing_id()), "scores")
    tails = whole.select("row", F.explode("tails").alias("t")).select("row", F.col("t.word").alias("word"), F.col("t.n").alias("times"))
    c = F.coalesce("n", F.lit(0))
    rest_of = F.element_at(F.array(*map(F.lit, model.rest_of.tolist())), (ending_column("word") + 1).cast("int"))
    sums = tails.join(model.rare, "word", "left").groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.col("times") * F.log10((c + ADD) / model.base_of)).alias("base"),
        F.sum(F.col("times") * F.log10((c + ADD) / rest_of)).alias("rest"),
    )
    out = whole.drop("tails").join(sums, "row", "left")
    add = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    return out.select("doc_id", "n_tokens", add("n_known", "known"), add("base_score", "base"), add("score", "rest"))


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = Model(docs.where(~held_out()).select("text"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
