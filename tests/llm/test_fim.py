"""Fill-in-middle against a plain version on tokens."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from weftline.llm import fim


def units(text):
    return re.findall(r"[A-Za-z]+|[^A-Za-z]", text)


def plain_version(doc_id, text):
    text = text or ""
    t = units(text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return doc_id, len(t), "plain", None, None, text
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    p, m, s = ("".join(x) for x in (t[:a], t[a:b], t[b:]))
    form = "spm" if h4 % 100 < 20 else "psm"
    return doc_id, len(t), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


TEXTS = ["", None, "a", "word", " ", "\n\n", "Ünïcode 漢字 𝄞! x\x00y", "<P> inside", "has <M>", "<", "<S", "ends<", "x" * 5000, "é" * 3000, "ab 1\n" * 40000, "mixed Text, 12 - <P " * 300]


def test_as_plain_version(spark):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(400)] + [(3, "repeated id"), (3, "repeated id"), (None, "no id"), (-5, "negative id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    made = fim.with_restored(fim.fill_in_middle(docs)).collect()
    key = lambda r: (str(r[0]), str(r[5]))
    assert sorted((tuple(r)[:6] for r in made), key=key) == sorted((plain_version(*r) for r in rows), key=key)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t or "")
    assert all(r.restored in texts[r.doc_id] for r in made)
    assert {r.form for r in made} == {"plain", "psm", "spm"}


def test_clashing_columns_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "some text here", "mine", 7)], "doc_id long, text string, output string, n int").withColumn("draw", F.lit(1)).withColumn("form", F.lit("mine"))
    assert [tuple(r) for r in fim.fill_in_middle(docs).collect()] == [plain_version(1, "some text here")]
    assert fim.with_restored(fim.fill_in_middle(docs.limit(0))).collect() == []
    with pytest.raises(ValueError):
        fim.with_restored(fim.fill_in_middle(docs), into="n")


def test_null_outputs(spark):
    got = fim.with_restored(spark.createDataFrame([(None, "psm"), ("<P>a<S>b<M>c", None), ("<P>a<S>b<M>c", "psm"), ("", "plain")], "output string, form string"))
    assert [r.restored for r in got.collect()] == [None, None, "acb", ""]


@pytest.mark.parametrize("leaf, window", [(1, 5), (16, 64), (1024, 1 << 20)])
def test_ropes(monkeypatch, leaf, window):
    monkeypatch.setattr(fim, "LEAF", leaf)
    monkeypatch.setattr(fim, "WINDOW", window)
    for text in [t for t in TEXTS if t and len(t) < 10000]:
        t = units(text)
        rope = fim.Rope.of(text.encode())
        assert (rope.units, rope.chars, bytes(rope).decode()) == (len(t), len(text), text)
        for k in {0, 1, len(t) // 3, len(t) - 1, len(t)}:
            a, b = rope.split(k)
            assert (bytes(a).decode(), bytes(b).decode(), a.units, b.units, b.chars) == ("".join(t[:k]), "".join(t[k:]), k, len(t) - k, len("".join(t[k:])))
            a, b = rope.split(k, "chars")
            assert bytes(a).decode() == text[:k] and bytes(fim.join(a, b)).decode() == text
        assert rope.height <= 2 + len(text.encode()).bit_length()
