"""Fill-in-the-middle: a text as a rope whose leaves know their units and code points, split at unit ranks and joined again in another order."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from weftline.llm.store import batched

#: Bytes of a leaf, but for a run of letters, which no leaf boundary cuts; bytes that are looked at together.
LEAF, WINDOW = 1024, 1 << 20
#: What stands before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _unit_starts(b: np.ndarray, before: bool) -> np.ndarray:
    """Bytes at which a unit begins: a run of letters A-Z or a-z, or one other code point. ``before``: a letter stands before ``b``."""
    letter = _LETTER[b]
    start = (b & 0xC0) != 0x80
    start[1:] &= ~(letter[1:] & letter[:-1])
    if before and len(b) and letter[0]:
        start[0] = False
    return start


class Rope:
    """A binary tree of bytes; every node keeps the units and code points below it, so that a rank is found in as many steps as the tree is high."""

    __slots__ = ("units", "chars", "height", "left", "right", "data")

    def __init__(self, units: int, chars: int, height: int = 0, left: Rope | None = None, right: Rope | None = None, data: bytes = b"") -> None:
        self.units, self.chars, self.height, self.left, self.right, self.data = units, chars, height, left, right, data

    @classmethod
    def of(cls, text: bytes) -> Rope:
        """The balanced rope of a text in UTF-8; leaves begin where units begin."""
        b = np.frombuffer(text, np.uint8)
        cuts, units, at = [], [], 0
        for w in range(0, len(b), WINDOW):
            part = b[w : w + WINDOW]
            starts = np.flatnonzero(_unit_starts(part, w > 0 and bool(_LETTER[b[w - 1]])))
            first = np.unique(np.searchsorted(starts, np.arange(0, len(part), LEAF)))
            first = first[first < len(starts)]
            cuts.append(starts[first] + w)
            units.append(first + at)
            at += len(starts)
        if not at:
            return cls(0, 0)
        cuts, units = np.append(np.concatenate(cuts), len(b)), np.append(np.concatenate(units), at)
        chars = np.add.reduceat((b & 0xC0) != 0x80, cuts[:-1], dtype=np.int64).tolist()
        leaves = [cls(u, c, data=text[a:z]) for u, c, a, z in zip(np.diff(units).tolist(), chars, cuts[:-1].tolist(), cuts[1:].tolist())]
        while len(leaves) > 1:
            leaves = [_node(*leaves[i : i + 2]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
        return leaves[0]

    def leaves(self) -> Iterator[bytes]:
        todo = [self]
        while todo:
            x = todo.pop()
            if x.height:
                todo += [x.right, x.left]
            else:
                yield x.data

    def __bytes__(self) -> bytes:
        return b"".join(self.leaves())

    def split(self, rank: int, by: str = "units") -> tuple[Rope, Rope]:
        """What stands before and from the unit (or, ``by`` chars, the code point) of a rank; ranks beyond the end give an empty second part."""
        if rank <= 0:
            return EMPTY, self
        if rank >= getattr(self, by):
            return self, EMPTY
        if not self.height:
            b = np.frombuffer(self.data, np.uint8)
            starts, lead = _unit_starts(b, False), (b & 0xC0) != 0x80
            at = int(np.flatnonzero(starts if by == "units" else lead)[rank])
            units, chars = (int(np.count_nonzero(x[:at])) for x in (starts, lead))
            return Rope(units, chars, data=self.data[:at]), Rope(self.units - units, self.chars - chars, data=self.data[at:])
        n = getattr(self.left, by)
        if rank < n:
            a, b = self.left.split(rank, by)
            return a, join(b, self.right)
        a, b = self.right.split(rank - n, by)
        return join(self.left, a), b


EMPTY = Rope(0, 0)


def _node(a: Rope, b: Rope) -> Rope:
    return Rope(a.units + b.units, a.chars + b.chars, 1 + max(a.height, b.height), a, b)


def join(a: Rope, b: Rope) -> Rope:
    """Both in a row, the lower tree hung into the higher one at its own height. Units add up, as no run of letters goes on from ``a`` to ``b``."""
    if not a.chars or not b.chars:
        return a if a.chars else b
    if a.height > b.height + 1:
        return _node(a.left, join(a.right, b))
    if b.height > a.height + 1:
        return _node(join(a, b.left), b.right)
    return _node(a, b)


def _joined(*parts: Rope) -> Rope:
    out = EMPTY
    for p in parts:
        out = join(out, p)
    return out


@lru_cache(16)
def _mark(sentinel: str) -> Rope:
    return Rope.of(sentinel.encode())


def rearranged(rope: Rope, a: int, b: int, form: str, sentinels: tuple[str, str, str] = SENTINELS) -> tuple[Rope, Rope, Rope]:
    """The output for a middle from unit ``a`` up to unit ``b``, with its prefix and middle."""
    rest, suffix = rope.split(b)
    prefix, middle = rest.split(a)
    p, s, m = map(_mark, sentinels)
    if form == "spm":
        return _joined(s, suffix, p, prefix, m, middle), prefix, middle
    return _joined(p, prefix, s, suffix, m, middle), prefix, middle


def restored(output: bytes, form: str, sentinels: tuple[str, str, str] = SENTINELS) -> bytes:
    """The text that gave ``output``. A text with sentinels of its own is plain, so in other forms each stands once."""
    if form == "plain":
        return output
    p, s, m = (x.encode() for x in sentinels)
    first, second = (s, p) if form == "spm" else (p, s)
    i = output.index(second, len(first))
    j = output.index(m, i + len(second))
    rank = lambda n: int(np.count_nonzero((np.frombuffer(output[:n], np.uint8) & 0xC0) != 0x80))
    rest, last = Rope.of(output).split(rank(j), "chars")
    head, tail = rest.split(rank(i), "chars")
    head, tail, middle = (x.split(len(mark.decode()), "chars")[1] for x, mark in ((head, first), (tail, second), (last, m)))
    prefix, suffix = (tail, head) if form == "spm" else (head, tail)
    return bytes(_joined(prefix, middle, suffix))


def _texts(column: pa.Array) -> Iterator[bytes]:
    return (x.as_buffer().to_pybytes() for x in column.cast(pa.large_string()).cast(pa.large_binary()))


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 1, plain: int = 10, spm: int = 20, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row: whole texts, cut at two of their n + 1 unit ranks and rearranged.

    Draws come from the SHA-256 of ``seed``, a colon and the id, so reruns and other partitionings agree: two ranks, then whether the text stays
    ``plain`` (percent), then whether it is ``spm`` (percent of the rest) or psm. Empty texts and texts that hold a sentinel are plain too; their
    counts of code points are null. A null text is empty, a null id draws as an empty one. Rows that repeat an id draw alike, and every row has
    a row. Other columns of ``docs`` take no part, whatever their names. Empty tables give empty tables. One text is held by a task at a time,
    with its rope: about three times its bytes.
    """
    marks = [x.encode() for x in sentinels]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for t, h in zip(_texts(b.column("text")), b.column("draw").to_pylist()):
                h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
                rope = Rope.of(t)
                if not t or any(x in t for x in marks) or h3 % 100 >= 100 - plain:
                    row = rope.units, "plain", None, None, t
                else:
                    form = "spm" if h4 % 100 < spm else "psm"
                    a, z = sorted((h1 % (rope.units + 1), h2 % (rope.units + 1)))
                    made, prefix, middle = rearranged(rope, a, z, form, sentinels)
                    row = rope.units, form, prefix.chars, middle.chars, bytes(made)
                for c, v in zip(out, row):
                    c.append(v)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64()]
            made = pa.array(out[4], pa.large_binary()).cast(pa.large_string()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds)), made], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    rows = batched(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), draw.alias("draw"))
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def with_restored(made: DataFrame, output: str = "output", form: str = "form", into: str = "restored") -> DataFrame:
    """``made`` with the text that each ``output`` came from, by its form alone. Null outputs or forms give null; a column named ``into`` must not be there."""
    if into in made.columns:
        raise ValueError(f"there is a column {into} already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            filled = b.column(output).fill_null("")
            got = [None if not ok or f is None else restored(t, f) for t, f, ok in zip(_texts(filled), b.column(form).to_pylist(), b.column(output).is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.large_binary()).cast(pa.large_string()).cast(pa.string())], [*b.schema.names, into])

    return batched(made).mapInArrow(run, StructType([*made.schema.fields, StructField(into, StringType())]))
