"""Grammar-compressed token files against the tokenizer itself."""

import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from weftline.llm import token_files
from weftline.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", None, " ", "  ", "a", " a", "a  b", "a\n b", "a \n", "don't stop, it's 'quoted' 's", "x\n\ny", "tab\there \t", "end. \n\n  next", "no break  here", "ideo　graphic 　 space", "thin   space", "漢字 仮名 漢字",
    "naïve café, São Paulo; x×y ÷ z", "numbers 12 345,67 a1b2c3", "<|endoftext|> inside  <|endoftext|>", "ends <|endoftext|", "\x00\x1c \x1d\x85 ctrl", "word.\nNext,line\n", "foo,bar\n.baz", "é combining", "𝄞 music  𝄞", "a" * 20000, "ab " * 30000, "same line\n" * 4000,
]


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda text: array("I", [*t.encode(text or "", add_special_tokens=False).ids, 0]).tobytes()


def test_ids_as_the_tokenizer(encode):
    known = token_files.Encoder(PATH)
    texts = [(t or "").encode() for t in TEXTS]
    for part in (texts, texts[::-1], texts[:3] * 3):
        assert known.ids(part) == [encode(t.decode()) for t in part]


def test_random_texts_as_the_tokenizer(encode):
    r = np.random.default_rng(3)
    bits = ["word", "Wörter", " ", "  ", "\n", "\t", "'", "'s", ",", "...", "12", "é", "×", " ", " ", "漢", "<|", "\x1f", "-"]
    texts = ["".join(r.choice(bits, r.integers(0, 30))) for _ in range(3000)]
    assert token_files.Encoder(PATH).ids([t.encode() for t in texts]) == [encode(t) for t in texts]


@pytest.mark.parametrize("kind", ["one id", "two ids", "few ids", "many ids", "periods", "single ids"])
def test_compression_is_inverted(kind):
    r = np.random.default_rng(4)
    n = 5000
    ids = {"one id": np.full(n, 7), "two ids": r.integers(0, 2, n), "few ids": r.integers(0, 20, n), "many ids": r.integers(0, 50000, n), "periods": np.tile(r.integers(0, 900, 50), n // 50), "single ids": np.arange(n)}[kind].astype(np.uint32)
    ends = np.unique(np.append(r.integers(1, n, 40), n))
    rules, spans, symbols, first = token_files.compress(ids, ends, 50257, least=2)
    assert (token_files.expanded(symbols, rules, 50257) == ids).all()
    assert all((rules[k] < 50257 + k).all() and spans[k] == len(token_files.expanded(rules[k], rules, 50257)) for k in range(len(rules)))
    begins, cuts = np.append(0, ends[:-1]), np.append(first, len(symbols))
    for d in range(len(ends)):
        own, part = ids[begins[d] : ends[d]], symbols[cuts[d] : cuts[d + 1]]
        for a, z in [(0, len(own)), (1, 3), (len(own) // 2, len(own) + 9), (-2, 1), (len(own), len(own) + 1)]:
            assert (token_files.between(part, rules, spans, 50257, a, z) == own[max(a, 0) : z]).all()
    if kind in ("one id", "periods"):
        assert len(symbols) < n / 4


def test_files_read_back(spark, encode):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(-3, 60)] + [(5, "again"), (5, "again"), (None, "no id"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("shard", F.lit("mine")).withColumn("tie", F.lit(1)).withColumn("part", F.lit(2))
    file = token_files.write(docs, PATH, block=3000)
    assert file.count() > 5
    got = sorted(token_files.read(file, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d))
    at, left = 0, [(d, encode(t)) for d, t in rows]
    for r in got:
        left.remove((r.doc_id, bytes(r.ids)))
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids) // 4, zlib.crc32(r.ids))
        at += r.n_tokens
    assert not left
    wanted = spark.createDataFrame([(7, 0, 5), (27, 100, 50), (27, 59990, 10**6), (27, 100, 50), (999, 0, 1), (None, 0, 1), (0, 0, 0)], "doc_id long, first long, length long")
    spans = sorted((r.doc_id, r.first, bytes(r.ids)) for r in token_files.read_spans(file, wanted).collect())
    own = lambda d, a, n: encode(dict(rows)[d])[4 * a : 4 * (a + n)]
    assert spans == sorted([(7, 0, own(7, 0, 5)), (27, 100, own(27, 100, 50)), (27, 100, own(27, 100, 50)), (27, 59990, own(27, 59990, 10**6)), (0, 0, b"")])


def test_no_documents(spark):
    file = token_files.write(spark.createDataFrame([], "doc_id long, text string"), PATH)
    assert token_files.read(file).collect() == []


def test_query_on_a_table(spark, encode, tmp_path):
    rows = [(9, "b c"), (2, "a"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, QUERIES["op13_token_id_files"](spark, str(tmp_path)).collect()))
    want, at = [], 0
    for d, t in sorted(rows):
        ids = encode(t)
        want.append((d, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert got == want
