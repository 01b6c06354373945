"""Licence notices in whole texts, with a few errors allowed: exact seeds first, then bounded-error matching."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from weftline.llm.store import batched

#: Words: runs of other than these; upper case falls to lower case first.
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32) for c in range(256))


class Notice(NamedTuple):
    label: str
    words: str
    errors: int
    base: bool = False


#: The three base phrases, which match exactly, then the method's own notices with their allowed errors.
NOTICES = (
    Notice("cc-by", "cc by", 0, True),
    Notice("gpl", "general public license", 2, True),
    Notice("reserved", "all rights reserved", 2, True),
    Notice("apache", "licensed under the apache license version 2 0", 4),
    Notice("bsd", "redistribution and use in source and binary forms", 4),
    Notice("cc-by-nc", "cc by nc", 0),
    Notice("cc-by-nd", "cc by nd", 0),
    Notice("cc-by-sa", "cc by sa", 0),
    Notice("cc0", "creative commons zero", 2),
    Notice("creative-commons", "creative commons attribution", 3),
    Notice("mit", "released under the mit license", 3),
    Notice("mit", "permission is hereby granted free of charge", 4),
    Notice("mpl", "mozilla public license", 2),
    Notice("public-domain", "released into the public domain", 3),
)


class Span(NamedTuple):
    label: str
    first: int
    last: int
    errors: int
    base: bool
    similarity: float


@lru_cache(8)
def _machine(notices: tuple[Notice, ...]) -> tuple[ahocorasick.Automaton, list]:
    """All seeds: each phrase, blanks around it, cut into errors + 1 pieces, one of which is exact in any match."""
    found: dict[str, list] = {}
    patterns = []
    for k, n in enumerate(notices):
        whole, parts = f" {n.words} ", n.errors + 1
        for p in range(parts):
            a, b = len(whole) * p // parts, len(whole) * (p + 1) // parts
            found.setdefault(whole[a:b], []).append((k, a))
        patterns.append(regex.compile(rf"(?b)(?:{regex.escape(whole)}){{e<={n.errors}}}") if n.errors else None)
    machine = ahocorasick.Automaton()
    for seed, where in found.items():
        machine.add_word(seed, (len(seed), where))
    machine.make_automaton()
    return machine, patterns


@lru_cache(4096)
def _verified(pattern: regex.Pattern, window: str) -> tuple[int, int, int] | None:
    """Start, end and errors of the best match in a window."""
    m = pattern.search(window)
    return m and (m.start(), m.end(), sum(m.fuzzy_counts))


def scan(text: bytes, notices: tuple[Notice, ...] = NOTICES) -> tuple[int, list[Span]]:
    """Number of words and all notices of a text, by place; first and last are words from 0."""
    words = text.translate(_TABLE).split()
    if not words:
        return 0, []
    line = f" {b' '.join(words).decode('latin-1')} "
    machine, patterns = _machine(notices)
    near: dict[int, set[int]] = {}
    for end, (n, where) in machine.iter(line):
        for k, a in where:
            near.setdefault(k, set()).add(end - n + 1 - a)
    spans = []
    for k, starts in near.items():
        notice, whole, reach = notices[k], f" {notices[k].words} ", notices[k].errors
        taken = -1
        for s in sorted(starts):
            if s >= 0 and line.startswith(whole, s):
                taken = s + len(whole) - 1
                spans.append((s, s + len(whole), k, 0))
            elif reach and s + len(whole) // 2 > taken:
                at = max(0, s - reach)
                window = line[at : s + len(whole) + reach]
                if (m := _verified(patterns[k], window)) and not line.startswith(whole, at + m[0]) and at + m[0] >= taken:
                    taken = at + m[1] - 1
                    spans.append((at + m[0], at + m[1], k, m[2]))
    out, at, n = [], 0, -1
    for a, b, k, errors in sorted(set(spans)):
        while line[a] != " " and a:  # an edit may have cut into a word
            a -= 1
        b = b if line[b - 1] == " " else line.index(" ", b) + 1
        n += line.count(" ", at, a + 1) if a + 1 >= at else -line.count(" ", a + 1, at)
        at = a + 1
        out.append(Span(notices[k].label, n, n + line.count(" ", a + 1, b) - 1, errors, notices[k].base and not errors, 1 - errors / len(notices[k].words)))
    return len(words), out


def licences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Texts are read whole, null ones as empty (no words, no labels, score 0). A notice is a phrase of words that stand
    consecutively; base phrases count where they stand exactly, every notice is also found with up to its number of
    character errors. A match with e errors holds one of its e + 1 pieces unchanged, so seeds lose none of them. The score is that of the
    most similar notice (1: exact); spans list label, first and last word and errors of each place.
    """
    kind = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,last:long,errors:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column("text").cast(pa.large_string()).cast(pa.large_binary()):
                n, spans = scan(t.as_buffer().to_pybytes() if t.is_valid else b"", notices)
                base = [s for s in spans if s.base]
                rows.append({
                    "n_words": n, "n_base": len(base), "first_word": min((s.first for s in base), default=None), "last_word": max((s.first for s in base), default=None),
                    "base_labels": ",".join(sorted({s.label for s in base})), "labels": ",".join(sorted({s.label for s in spans})), "score": max((s.similarity for s in spans), default=0.0),
                    "spans": [{"label": s.label, "first": s.first, "last": s.last, "errors": s.errors} for s in spans]})
            out = pa.RecordBatch.from_pylist(rows, SCHEMA)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *out.columns], ["doc_id", *out.schema.names])

    return batched(docs).selectExpr(f"`{doc_id}` as doc_id", f"`{text}` as text").mapInArrow(run, kind)


SCHEMA = pa.schema([(x, pa.int64()) for x in ("n_words", "n_base", "first_word", "last_word")] + [("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("errors", pa.int32())])))])
