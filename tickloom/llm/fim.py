"""Fill-in-middle transformation on piece tables.

A document is a list of pieces, descriptors (buffer, start, length) in code points over two
immutable buffers: its text and the sentinels.  Nothing is copied while it is worked on:

* ``cut`` splits descriptors at two token boundaries into prefix, middle and suffix;
* an arrangement is a permutation of the parts with a sentinel before each (``ARRANGED``);
* the output's own piece table is found from its sentinels alone, and the inverse permutation
  of its parts restores the document;
* digests stream over the descriptors in bounded slices.

Token boundaries are found with vectorised comparisons of code points, one document at a
time, so memory is bounded by the longest document.  Every row is independent: no shuffle.

Cases: null and empty texts are plain with no tokens; texts of white space are one token; a
text with a sentinel in it stays plain; a null doc_id draws like the empty string; repeated
rows draw alike; an empty table gives no rows; columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

SENTINELS = "<P><S><M>"
MARK = 3  # code points of a sentinel
PREFIX, MIDDLE, SUFFIX = range(3)
SENTINEL_OF = {PREFIX: 0, SUFFIX: MARK, MIDDLE: 2 * MARK}
#: the order in which a form shows the parts
ARRANGED = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
TEXT, SENTINEL = 0, 1
SLICE = 1 << 16

RESULT = (
    "n long, form string, prefix_chars long, middle_chars long, "
    "pieces array<struct<buffer:int,start:long,length:long>>, output_sha256 string, restored_sha256 string"
)


class Piece(NamedTuple):
    buffer: int
    start: int
    length: int


def token_ends(text: str) -> np.ndarray:
    """Where tokens end: after each run without white space, and after white space at the end."""
    units = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    blank = (units == 0x20) | ((units >= 0x09) & (units <= 0x0D))
    if not len(units):
        return np.zeros(0, dtype=np.int64)
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    return np.append(ends, len(units))


def cut(pieces: list[Piece], at: int) -> list[Piece]:
    """The same sequence with a descriptor boundary ``at`` code points from its start."""
    out, seen = [], 0
    for p in pieces:
        left = min(max(at - seen, 0), p.length)
        out += [q for q in (Piece(p.buffer, p.start, left), Piece(p.buffer, p.start + left, p.length - left)) if q.length]
        seen += p.length
    return out


def parts_of(pieces: list[Piece], ends: tuple[int, int]) -> list[list[Piece]]:
    """Prefix, middle and suffix as descriptor lists; ``ends`` are the two cuts."""
    for at in ends:
        pieces = cut(pieces, at)
    parts, seen = [[], [], []], 0
    for p in pieces:
        parts[(seen >= ends[0]) + (seen >= ends[1])].append(p)
        seen += p.length
    return parts


def arrange(parts: list[list[Piece]], form: str) -> list[Piece]:
    """The parts in the order of ``form``, each behind its sentinel but a leading part's text shares none."""
    out: list[Piece] = []
    for part in ARRANGED[form]:
        out += [Piece(SENTINEL, SENTINEL_OF[part], MARK), *parts[part]]
    return out


def restore(output: str, form: str) -> list[Piece]:
    """Descriptors over ``output`` that spell the document, by the inverse of the arrangement."""
    if form == "plain":
        return [Piece(TEXT, 0, len(output))]
    shown, starts, at = ARRANGED[form], [], 0
    for part in shown:
        mark = SENTINELS[SENTINEL_OF[part] : SENTINEL_OF[part] + MARK]
        at = output.index(mark, at)
        starts.append(at)
        at += MARK
    ends = [*starts[1:], len(output)]
    inverse = [shown.index(part) for part in (PREFIX, MIDDLE, SUFFIX)]
    return [Piece(TEXT, starts[i] + MARK, ends[i] - starts[i] - MARK) for i in inverse]


def slices(pieces: list[Piece], buffers: tuple[str, ...]) -> Iterator[str]:
    for p in pieces:
        for at in range(p.start, p.start + p.length, SLICE):
            yield buffers[p.buffer][at : min(at + SLICE, p.start + p.length)]


def digest(pieces: list[Piece], buffers: tuple[str, ...]) -> str:
    h = hashlib.sha256()
    for s in slices(pieces, buffers):
        h.update(s.encode("utf-8", "surrogatepass"))
    return h.hexdigest()


def transform(name: str, text: str, seed: int = 42, fim_percent: int = 50, spm_percent: int = 80) -> tuple:
    """One document; ``name`` is its id as decimal text.  Columns as in ``RESULT``."""
    h = hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    ends = token_ends(text)
    n, whole = len(ends), [Piece(TEXT, 0, len(text))] if text else []
    marks = (SENTINELS[i : i + MARK] for i in SENTINEL_OF.values())
    if not text or any(m in text for m in marks) or h3 % 100 >= fim_percent:
        form, lengths, pieces = "plain", (None, None), whole
    else:
        form = "spm" if h4 % 100 < spm_percent else "psm"
        low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
        first, second = (int(ends[k - 1]) if k else 0 for k in (low, high))
        lengths, pieces = (first, second - first), arrange(parts_of(whole, (first, second)), form)
    buffers = (text, SENTINELS)
    output = "".join(slices(pieces, buffers))
    return n, form, *lengths, pieces, digest(pieces, buffers), digest(restore(output, form), (output,))


def fill_in_middle(docs: DataFrame, seed: int = 42, fim_percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """doc_id, text (null as empty) and the columns of ``RESULT`` for every row; ``output`` gives the new text."""

    @F.pandas_udf(RESULT)
    def cut_and_arrange(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RESULT.replace("struct<buffer:int,start:long,length:long>", "").split(", ")]
        for ids, texts in batches:
            rows = [transform(i, t, seed, fim_percent, spm_percent) for i, t in zip(ids, texts, strict=True)]
            out = pd.DataFrame(rows, columns=names)
            for c in ("prefix_chars", "middle_chars"):
                out[c] = out[c].astype("Int64")
            out["pieces"] = [[p._asdict() for p in pieces] for pieces in out["pieces"]]
            yield out

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return given.select("doc_id", "text", cut_and_arrange(name, "text").alias("r")).select("doc_id", "text", "r.*")


def output(text: Column | str = "text", pieces: Column | str = "pieces") -> Column:
    """The transformed text, spelled natively from a row's text and its pieces."""
    text = F.col(text) if isinstance(text, str) else text
    spell = F.transform(
        pieces,
        lambda p: F.when(p["buffer"] == TEXT, F.substring(text, p["start"].cast("int") + 1, p["length"].cast("int"))).otherwise(
            F.substring(F.lit(SENTINELS), p["start"].cast("int") + 1, p["length"].cast("int"))
        ),
    )
    return F.array_join(spell, "")
