import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from weftline.llm import substrings


def brute(texts, words, window):
    docs = [words(t) for t in texts]
    seen = Counter(tuple(d[i : i + window]) for d in docs for i in range(len(d) - window + 1))
    out = []
    for d in docs:
        gone = {i + k for i in range(len(d) - window + 1) if seen[tuple(d[i : i + window])] > 1 for k in range(window)}
        kept = " ".join(w for i, w in enumerate(d) if i not in gone)
        out.append((len(d), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(r.choice([2, 6, 300]))] + ["é", "the", "the."]
    prose = lambda k: [r.choice(vocabulary) for _ in range(k)]
    passages = [prose(r.choice([30, 34, 35, 36, 50, 90])) for _ in range(6)] + [["a"] * 80, ["a", "b"] * 40, ["x"] * 35]
    texts = []
    for _ in range(n):
        w = prose(r.randrange(0, 60))
        for _ in range(r.randrange(0, 3)):
            at = r.randrange(0, len(w) + 1)
            w[at:at] = r.choice(passages)
        texts.append(r.choice([" ", "\n", " \t\r\n"]).join(w))
    return [*texts, None, "", "   ", texts[0], texts[1] + " tail"]


@pytest.mark.parametrize("window", [35, 24, 12, 3])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_as_brute_force(spark, brute_words, seed, window):
    texts = corpus(seed)
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), window=window).collect()}
    assert [got[i] for i, _ in rows] == brute(texts, brute_words, window)


def test_rows_of_one_id_clashing_columns_and_no_rows(spark, brute_words):
    text = " ".join(f"v{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, "k", 1), (1, text, "k", 1), (2, "a b", "m", 2), (None, text + " z", None, None)], "doc_id long, text string, kept string, n_chars long")
    got = sorted(map(tuple, substrings.cleaned(docs, n_chars="n_chars").collect()), key=str)
    assert got == sorted([(1, "", "k", 0), (1, "", "k", 0), (2, "a b", "m", 3), (None, "z", None, 1)], key=str)
    assert substrings.digest(docs.limit(0)).collect() == []


def test_span_hashes_are_of_their_words_alone():
    h = np.random.default_rng(0).integers(0, 2**63, 50, dtype=np.uint64)
    for n in (1, 2, 3, 16, 35):
        both = substrings.spans(np.concatenate([h, h]), n)
        assert (both[: 50 - n + 1] == both[50:]).all() and len(both) == 100 - n + 1
