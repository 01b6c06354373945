import random

import pytest
from pyspark.sql import functions as F

from weftline.llm import identity, ngrams, substrings
from tests.llm.test_ngrams import brute as brute_links
from tests.llm.test_ngrams import corpus as linked_corpus
from tests.llm.test_substrings import brute as brute_repeats
from tests.llm.test_substrings import corpus as repeated_corpus


@pytest.fixture
def few_hashes(monkeypatch):
    """The first hashes of rows have 3 values, so that most rows collide."""
    real = identity._hash
    monkeypatch.setattr(identity, "_hash", lambda seed, columns: F.pmod(real(seed, columns), F.lit(3)) if seed in (0, 2) else real(seed, columns))


def test_rows_are_told_apart(spark, few_hashes):
    rows = [(i % 7 or None, random.Random(i % 20).choice("abc") if i % 5 else None, f"uid{i}") for i in range(100)]
    got = identity.identified(spark.createDataFrame(rows, "doc_id long, text string, uid string"), "doc_id", "text").select("row.*", F.col("uid").alias("known")).toDF("doc_id", "text", "uid", "known").collect()
    by = {}
    for r in got:
        by.setdefault(r.known, set()).add((r.doc_id, r.text))
    assert all(len(x) == 1 for x in by.values()) and len(by) == len({x[:2] for x in rows}) and sorted(map(str, (r[:3] for r in got))) == sorted(map(str, map(tuple, rows)))


def test_nulls_count_in_numbers(spark):
    rows = spark.createDataFrame([("a", None), (None, "a"), (None, None), ("", None), (None, "")], "doc_id string, text string")
    assert identity.identified(rows, "doc_id", "text").select("uid").distinct().count() == 5
    assert identity.identified(rows.limit(0), "doc_id", "text").collect() == []


def test_repeats_as_brute_force_where_rows_collide(spark, brute_words, few_hashes):
    texts = repeated_corpus(2)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, brute_words, 35)


def test_links_as_brute_force_where_rows_and_sets_collide(spark, brute_words, few_hashes, monkeypatch):
    real = ngrams.fingerprint
    monkeypatch.setattr(ngrams, "fingerprint", lambda x: (real(x)[0] >> 61 << 2, real(x)[1]))
    rows = linked_corpus(2)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_links(rows, brute_words)
    assert sorted(map(tuple, ngrams.near_duplicates(docs).collect())) == want
    assert sorted(r.doc_id for r in ngrams.without_near_duplicates(docs).collect()) == sorted(d for d, _, c in want if d == c)


def test_more_shared_numbers_than_the_bound_are_an_error(spark, monkeypatch):
    real = ngrams.fingerprint
    monkeypatch.setattr(ngrams, "fingerprint", lambda x: (real(x)[0] >> 61 << 2, real(x)[1]))
    monkeypatch.setattr(ngrams, "SHARED", 1)
    with pytest.raises(ValueError, match="too many sets"):
        ngrams.near_duplicates(spark.createDataFrame(linked_corpus(2), "doc_id long, text string"))
