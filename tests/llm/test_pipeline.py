"""Each stage of the corpus pipeline against a plain version, on its own input."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from test_ngrams import brute as near_brute
from test_substrings import brute as repeats_brute


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(3)
    path = str(tmp_path_factory.mktemp("sf"))
    good = lambda n: " ".join(r.choice(["river", "stone", "went", "over", "the", "old", "town", "and", "light", "came", "w%d" % r.randrange(400)]) for _ in range(n))
    bad = lambda n: " ".join(r.choice(["BUY", "now!!", "$$$", "click"]) for _ in range(n))
    rows = [(i, good(80) if i % 2 == 0 else bad(80)) for i in range(240)]
    shared = good(60)
    rows += [(300 + i, rows[2 * i][1] + " end") for i in range(10)] + [(400 + i, good(40) + " " + shared) for i in range(5)] + [(500, None), (501, "")]
    docs = spark.createDataFrame([(i, t, "en", "s%d" % (i % 3), len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder, brute_words, tmp_path):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near duplicates", "repeats", "mix", "pack"]

    def step(name, docs):
        path = str(tmp_path / name)
        stages[name](spark, docs, folder).write.parquet(path)
        return spark.read.parquet(path)

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = step("quality", docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert not any(i % 2 for i in ids if i < 240) and {i for i in range(0, 240, 2)} <= ids and set(range(400, 405)) <= ids

    single = step("near duplicates", kept)
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(r.doc_id for r in single.collect()) == sorted(d for d, n, least in near_brute(rows, brute_words) if d == least or n == 0)

    cut = step("repeats", single)
    before = {r.doc_id: r.text for r in single.collect()}
    wanted = dict(zip(before, repeats_brute(list(before.values()), brute_words, 35)))
    after = {r.doc_id: r for r in cut.collect()}
    assert after.keys() == before.keys()
    for i, (n, gone, _) in wanted.items():
        assert len(brute_words(after[i].text)) == n - gone and (gone or after[i].text == before[i]) and (after[i].text is None or after[i].n_chars == len(after[i].text))

    mixed = step("mix", cut)
    size, taken = Counter(), Counter()
    for r in cut.collect():
        size[r.source] += len(brute_words(r.text))
    for r in mixed.collect():
        taken[r.source] += len(brute_words(r.text))
    assert mixed.columns == docs.columns and abs(sum(taken.values()) - 1.5 * sum(size.values())) <= 3 and all(taken[s] <= 2 * size[s] for s in size)

    packed = step("pack", mixed).collect()
    per = {}
    for r in packed:
        per.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {r.doc_id for r in packed} == {r.doc_id for r in mixed.collect()}
    for pieces in per.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
