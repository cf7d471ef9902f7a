"""Token ids as Parquet files: a list column in dictionary encoding, its metadata beside it in delta encoding.

Texts move once, into ranges of ids of about PART_BYTES of text, and are encoded there in ascending order, so that a file holds one
range and the files' order is the documents'. `first` counts the ids of the file before a document; what lies in earlier files is
a sum over one row for each file. Row groups and pages are small enough for a reader to skip most of them: Spark writes column and
offset indexes, and a filter on ids or on any kept column reaches row groups and pages. Readers that ask for metadata columns alone
don't touch the ids.

A text is a sequence of words, between spaces and line breaks, that the tokenizer treats apart (its normaliser joins nothing across
white space, its splits drop it); so words are encoded by the library once and then looked up. A word of letters with punctuation
behind it is two pieces that the splits keep apart; new pieces of letters go through the library many at a time, and each ends with
the one token that ends a word. Where a count doesn't agree, or a tokenizer isn't of this kind, words or whole texts are encoded one
by one. The cache is bounded and only saves time.

Strings of special tokens in a text follow the library's own rule: they are one id. A null text is an empty one; a null id comes
first, rows with equal ids are ordered by a hash of the text, then the text.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.common import documents, new_path, parts_of

END = 2
TOKENIZER = "word_bpe_49k.json"
PIECES = 400_000  # that a worker keeps at most
TOGETHER = 500  # new pieces that are encoded as one text
PUNCTUATION = np.array([chr(k).isprintable() and not chr(k).isalnum() and 32 < k < 127 for k in range(256)])
PART_BYTES = 64 << 20  # of text for a file
SLICE = 3 << 20  # bytes of text that a task encodes together
SMALL = np.array([k + 32 * (65 <= k <= 90) for k in range(256)], np.uint8)  # ASCII letters lower-cased
#: How Spark's writer lays the files out.
LAYOUT = {
    "compression": "zstd",
    "parquet.block.size": 16 << 20,
    "parquet.page.size": 128 << 10,
    "parquet.page.row.count.limit": 2000,
    "parquet.writer.version": "v2",
    "parquet.dictionary.page.size": 1 << 20,
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#first": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}

def strings(data) -> list[str]:
    """An Arrow array of bytes as strings."""
    import pyarrow as pa

    try:
        return data.cast(pa.large_string() if pa.types.is_large_binary(data.type) else pa.string()).to_numpy(zero_copy_only=False).tolist()
    except pa.ArrowInvalid:
        return [x.decode("utf-8", "replace") for x in data.to_pylist()]


def cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the punctuation behind each word begins: the place after its last byte that is none, or its start."""
    place = np.where(PUNCTUATION[data], -1, np.arange(len(data), dtype=np.int32))
    np.maximum.accumulate(place, out=place)
    some = ends > starts
    return np.where(some, np.maximum(starts, place[np.maximum(ends, 1) - 1] + 1), starts) if len(data) else starts


class Encoder:
    """The ids of texts, one text after the other, and where each ends."""

    def __init__(self, path: str, most: int = PIECES):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.now: dict[str, bytes] = {}  # pieces looked up lately, and those from before
        self.before: dict[str, bytes] = {}
        encode = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        probe = ["It's", "Ab,", "c3", "it", "don't--"]
        self.apart = encode(" ".join(probe)) == encode("\n  ".join(probe)) == [i for w in probe for i in encode(w)] and encode("ab,.") == encode("AB") + encode(",.")
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.last = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        self.last[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]] = True

    def __call__(self, texts) -> tuple[np.ndarray, np.ndarray]:
        import pyarrow as pa
        import pyarrow.compute as pc

        data = pc.fill_null(texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()), b"")
        if not self.apart:
            each = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in data.to_pylist()], add_special_tokens=False)]
            return np.concatenate([np.zeros(0, "<u4"), *each]), np.cumsum([len(x) for x in each], dtype=np.int64)
        lists = pc.split_pattern(pc.replace_substring(data, "\n", " "), " ")
        words, cuts = lists.flatten(), lists.offsets.to_numpy()
        offsets = np.frombuffer(words.buffers()[1], np.int64 if pa.types.is_large_binary(words.type) else np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        buffer = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        starts, ends = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
        small = SMALL[buffer]
        if any(t in small.tobytes() for t in self.special):  # such a string is one id: its words stay whole
            at, pool, size = self.looked_up(buffer, offsets - offsets[0])
            n = size[at]
        else:
            wide = np.concatenate([[0], np.cumsum(buffer >= 128, dtype=np.int32)])
            plain = wide[ends] == wide[starts]  # ASCII words are lower-cased: nothing in them composes
            buffer = np.where(np.repeat(plain, ends - starts), small, buffer)
            middle = cut(buffer, starts, ends)
            edge = middle[middle > starts] - 1
            apart = np.ones(len(starts), bool)
            apart[middle > starts] = buffer[edge] < 128
            apart |= self.letters_end(buffer, starts, middle, ~apart)
            middle = np.where(apart, middle, ends)
            tail = middle < ends
            bounds = np.concatenate([starts, middle[tail & (middle > starts)], ends[-1:]])
            bounds.sort()
            at, pool, size = self.looked_up(buffer, bounds) if len(starts) else (np.zeros(0, np.int64), np.zeros(0, "<u4"), np.zeros(0, np.int64))
            n = size[at]
            # pieces of each word: two where it is cut
            cuts = np.concatenate([[0], np.cumsum(1 + (tail & (middle > starts)))])[cuts - cuts[0]]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = pool[np.arange(total[-1]) + np.repeat((np.cumsum(size) - size)[at] - total[:-1], n)]
        return ids, total[cuts[1:] - cuts[0]]

    def letters_end(self, buffer: np.ndarray, starts: np.ndarray, middle: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Of the words asked for, whether the last character before the cut is a letter whose small form is one, too."""
        out, k = np.zeros(len(starts), bool), np.nonzero(asked)[0]
        four = np.stack([np.where(middle[k] - i > starts[k], buffer[np.maximum(middle[k] - i, 0)], 32) for i in (4, 3, 2, 1)], 1).astype(np.uint8) if len(k) else np.zeros((0, 4), np.uint8)
        each, of = np.unique(four.view("V4").ravel(), return_inverse=True) if len(k) else (np.zeros(0, "V4"), np.zeros(0, np.int64))
        letter = []
        for x in each:
            last = bytes(x).decode("utf-8", "replace")[-1:]
            letter.append(last.isalpha() and len(last.lower()) == 1 and last.lower().isalpha())
        out[k] = np.array(letter, bool)[of]
        return out

    def looked_up(self, buffer: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the pieces between the bounds: which entry each is, all entries' ids, and how many ids each entry has."""
        import pyarrow as pa

        kind, offset = (pa.large_binary(), np.int64) if bounds[-1] >= 1 << 31 else (pa.binary(), np.int32)
        own = pa.Array.from_buffers(kind, len(bounds) - 1, [None, pa.py_buffer(bounds.astype(offset)), pa.py_buffer(np.ascontiguousarray(buffer))]).dictionary_encode()
        found = self.ids_of(strings(own.dictionary))
        return own.indices.to_numpy(), np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4

    def ids_of(self, pieces: list[str]) -> list[bytes]:
        now, before = self.now, self.before
        out, new = list(map(now.get, pieces)), []
        for k, x in enumerate(out):
            if x is None:
                p = pieces[k]
                x = before.get(p)
                if x is None:
                    new.append(k)
                else:
                    out[k] = now[p] = x
        now.update(self.encoded([pieces[k] for k in new]))
        for k in new:
            out[k] = now[pieces[k]]
        if len(now) > self.most // 2:
            self.now, self.before = {}, now
        return out

    def encoded(self, pieces: list[str]) -> dict[str, bytes]:
        plain, single, out = [], [], {}
        for p in pieces:
            (plain if p.isalpha() else single).append(p)
        for a in range(0, len(plain), 20_000):
            groups = [plain[b : b + TOGETHER] for b in range(a, min(a + 20_000, len(plain)), TOGETHER)]
            for own, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, "<u4")
                ends = np.nonzero(self.last[ids])[0] + 1
                if len(ends) != len(own) or ends[-1] != len(ids):  # a piece that is several words, such as one whose small letters have marks
                    single += own
                    continue
                data, ends = ids.tobytes(), (4 * ends).tolist()
                out.update(zip(own, (data[x:y] for x, y in zip([0, *ends], ends, strict=False)), strict=True))
        for a in range(0, len(single), 20_000):
            part = single[a : a + 20_000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                out[w] = np.array(e.ids, "<u4").tobytes()
        return out


held: dict[str, Encoder] = {}  # of a worker


def encoder_of(path: str) -> Encoder:
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def write_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = (), tokenizer: str | None = None, end: int | None = END, part_bytes: int = PART_BYTES, layout: dict | None = None) -> None:
    """Writes doc_id, the columns of `keep`, first, n_tokens and tokens (with `end` after each document's own) to path, in ascending order of ids."""
    spark, path_of_tokenizer = df.sparkSession, tokenizer or default_tokenizer()
    names = ["doc_id", *(f"kept_{c}" if c in ("doc_id", "first", "n_tokens", "tokens", "_text") else c for c in keep)]
    own = df.select(*(F.col(c).alias(n) for c, n in zip([id_col, *keep], names, strict=True)), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    size = own.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes))
    order = [F.col("doc_id"), F.xxhash64("_text")]
    dealt = own.repartitionByRange(parts, *order).sortWithinPartitions(*order, "_text")

    def run(batches):
        import os

        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        before, encoder = 0, encoder_of(path_of_tokenizer)
        for batch in batches:
            for part in parts_of(batch, batch.num_columns - 1, SLICE):
                ids, ends = encoder(part.column(part.num_columns - 1))
                if end is not None:
                    ids, ends = np.insert(ids, ends, np.uint32(end)), ends + np.arange(1, len(ends) + 1)
                first = np.concatenate([[0], ends])[:-1]
                tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(before + first), pa.array((ends - first).astype(np.int32)), tokens], [*names, "first", "n_tokens", "tokens"])
                before += int(ends[-1]) if len(ends) else 0

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.drop("_text").schema]
    dealt.mapInArrow(run, ", ".join([*kinds, "first bigint", "n_tokens int", "tokens array<int>"])).write.options(**{k: str(v) for k, v in (LAYOUT | (layout or {})).items()}).parquet(path)


FILE = r"CAST(regexp_extract(_metadata.file_name, r'part-(\d+)', 1) AS BIGINT) AS file"


def read_tokens(spark: SparkSession, path: str, ids: tuple | None = None, columns: list[str] | None = None) -> DataFrame:
    """The written rows with file, the number of their file; ids: (least, greatest), which skips row groups and pages; columns: what is read."""
    df = spark.read.parquet(path)
    df = df.select(*(columns or df.columns), F.expr(FILE))
    return df if ids is None else df.where(F.col("doc_id").between(*ids))


def starts(spark: SparkSession, path: str) -> DataFrame:
    """file, before: the ids in earlier files. A row for each file, from two metadata columns."""
    each = read_tokens(spark, path, columns=["first", "n_tokens"]).groupBy("file").agg(F.max(F.col("first") + F.col("n_tokens")).alias("total"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return each.select("file", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before"))


def with_checksums(rows: DataFrame) -> DataFrame:
    """rows with ids_crc32 in place of tokens: the checksum of the ids as little-endian unsigned 32-bit integers."""
    names = [c for c in rows.columns if c != "tokens"]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            at, flat = column.offsets.to_numpy(), column.values.to_numpy().astype("<i4", copy=False)
            sums = [zlib.crc32(flat[a:b].data) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sums, pa.int64())], [*names, "ids_crc32"])

    own = rows.select(*names, "tokens")
    return own.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own.drop("tokens").schema), "ids_crc32 bigint"]))


def op13_token_files(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token files")
    write_tokens(documents(spark, sf_dir), path)
    rows = with_checksums(read_tokens(spark, path, columns=["doc_id", "first", "n_tokens", "tokens"]))
    return rows.join(starts(spark, path), "file").select("doc_id", (F.col("before") + F.col("first")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids_crc32")
