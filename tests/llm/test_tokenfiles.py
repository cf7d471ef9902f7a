"""op13: ids as the library gives them, the files' layout, and reads that skip."""

import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import fixtures as fx
from tidewell.llm import queries, tokenfiles

ODD = ["J̌ust á Á\ńlone", "tab\tand\x1cfile sep\xa0nbsp\x85next", "It's WE'LL  they've\r\ndon't", "<|endoftext|> in text <|startoftext|>x", "ΑΣ ΌΔΟΣ. İstanbul ﬁne", "a" * 3000 + " " + "1" * 300, "  ", "\n\n", "😀😀 日本語テキスト"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenfiles.default_tokenizer())


def by_hand(library, rows):
    out, start = {}, 0
    for i, t in sorted(rows):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        out[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out


def test_op13(spark, tmp_path, library):
    rows = fx.rows() + [(3000 + k, t, "en", "b", 1) for k, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, fx.SCHEMA).select("*", *(F.lit("mine").alias(c.split()[0]) for c in fx.CLASHES.split(", ")), F.lit(1).alias("first"), F.lit(2).alias("tokens"))
    docs.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.QUERIES["op13_token_files"](spark, str(tmp_path)).collect()}
    assert got == by_hand(library, [(r[0], r[1]) for r in rows])


def test_empty_and_repeated(spark, tmp_path, library):
    fx.empty(spark).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.QUERIES["op13_token_files"](spark, f"{tmp_path}/none").collect() == []
    fx.odd(spark).write.parquet(f"{tmp_path}/odd/documents.parquet")
    got = queries.QUERIES["op13_token_files"](spark, f"{tmp_path}/odd").collect()
    want = [(r["doc_id"], len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1) for r in fx.odd(spark).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in got), key=key) == sorted(want, key=key)
    order = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in order] == np.cumsum([0] + [r["n_tokens"] for r in order])[:-1].tolist()
    assert [r["doc_id"] for r in order] == sorted((r["doc_id"] for r in order), key=lambda i: (i is not None, i or 0))  # no id: first


def encoded(encoder, texts):
    import pyarrow as pa

    ids, ends = encoder(pa.array(texts, pa.string()))
    return [x.tolist() for x in np.split(ids, ends[:-1])]


@pytest.mark.parametrize("most", [10, 400, 1_000_000])
def test_pieces_that_are_forgotten(library, most):
    few = tokenfiles.Encoder(tokenfiles.default_tokenizer(), most)
    texts = [t or "" for t in fx.texts()] + ODD + ["Stra\u00dfe... \u1e9e! e\u0301te\u0301, x\u00b2 \u2168, \u0130l \u0130, don't' 's 's' a's' -- ,a a,b ab,,", "\u1112\u1161\u11ab\u1100\u1173\u11af \u00aa\u02b0"]
    for _ in range(2):
        assert encoded(few, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


@given(st.lists(st.text(st.sampled_from("abEIst\u00c9\u0130\u0301\u030c'\u2019.,-!_ 1\u00b2\n\t\u00a0\u1e9e\u03a3"), max_size=30), max_size=5))
@settings(max_examples=300, deadline=None)
def test_any_text(texts):
    from tokenizers import Tokenizer

    if "whole" not in kept:
        kept["whole"] = Tokenizer.from_file(tokenfiles.default_tokenizer())
    want = [kept["whole"].encode(t, add_special_tokens=False).ids for t in texts]
    assert encoded(tokenfiles.encoder_of(tokenfiles.default_tokenizer()), texts or [""]) == (want or [[]])


kept: dict = {}


def test_tokenizers_of_another_kind():
    """One that keeps white space gets whole texts."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, library = tokenfiles.Encoder(path), Tokenizer.from_file(path)
    assert not encoder.apart
    texts = [t or "" for t in fx.texts()]
    assert encoded(encoder, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_layout_and_skipping(spark, tmp_path):
    rows = [(k, f"word{k % 7} of text {k} " * 20, "en" if k % 3 else "de", "s", 1) for k in range(4000)]
    tokenfiles.write_tokens(spark.createDataFrame(rows, fx.SCHEMA), f"{tmp_path}/t", keep=["lang"], part_bytes=1 << 20, layout={"parquet.block.size": 8 << 10, "parquet.page.row.count.limit": 50})
    files = sorted(p for p in (tmp_path / "t").iterdir() if p.name.startswith("part-"))
    meta = [pq.ParquetFile(p).metadata for p in files]
    assert sum(m.num_rows for m in meta) == 4000 and max(m.num_row_groups for m in meta) > 1
    columns = {meta[0].row_group(0).column(c).path_in_schema: meta[0].row_group(0).column(c) for c in range(meta[0].num_columns)}
    assert all(c.has_column_index and c.has_offset_index for c in columns.values())
    assert "RLE_DICTIONARY" in columns["tokens.list.element"].encodings and columns["n_tokens"].encodings == columns["doc_id"].encodings == ("DELTA_BINARY_PACKED",)
    ids = [x for p in files for x in pq.read_table(p, columns=["doc_id"])["doc_id"].to_pylist()]
    assert ids == sorted(ids)  # the files' order is the documents'
    part = tokenfiles.read_tokens(spark, f"{tmp_path}/t", ids=(100, 120), columns=["doc_id", "tokens"])
    plan = part._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,100), LessThanOrEqual(doc_id,120)]" in plan
    assert part.count() == 21
    only = tokenfiles.read_tokens(spark, f"{tmp_path}/t", columns=["doc_id", "lang"])._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in only
    with pytest.raises(Exception, match="already exists"):
        tokenfiles.write_tokens(spark.createDataFrame(rows[:3], fx.SCHEMA), f"{tmp_path}/t")
