"""Token counts by the whole-token shortcut.

A byte-level BPE first cuts a text into pre-tokens and then merges each one.
Most pre-tokens of ordinary text are themselves vocabulary strings.  Before any
document is read, every vocabulary string is run through the model's own merges:
those that come out as one token are proven whole.  A document then costs a
regular expression and one dictionary look-up per pre-token; only the pre-tokens
outside the proven set are merged, and remembered up to a bound.

Pre-tokens are cut by the published pattern of this tokenizer family.  Texts with
characters outside the ranges where that pattern and the library are known to
agree (``FAST``, tested code point by code point) are cut by the library itself.

Cases: null text counts as empty (0 bytes, 0 tokens); strings of added special
tokens inside a text count as one token, as the library does by default; repeated
rows and null ids keep their rows; columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import text_or_empty

# Characters for which ``cutter`` is used (code point ranges); others go through the library.
FAST = ((0x09, 0x0D), (0x20, 0x7E), (0xA0, 0x24F), (0x2010, 0x2027), (0x2030, 0x205E))
LIST_CHARS = 1 << 20  # longer texts are cut by an iterator, not into one list


def char_class(keep) -> str:
    """Members of FAST that ``keep`` accepts, as the inside of a character class."""
    return "".join(re.escape(chr(c)) for lo, hi in FAST for c in range(lo, hi + 1) if keep(chr(c)))


def cutter() -> re.Pattern:
    """The published pre-token pattern of byte-level BPE, spelled out for the characters of FAST."""
    letter = char_class(lambda c: unicodedata.category(c)[0] == "L")
    number = char_class(lambda c: unicodedata.category(c)[0] == "N")
    space = char_class(str.isspace)
    return re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{letter}]++| ?[{number}]++| ?[^{space}{letter}{number}]++|[{space}]+(?![^{space}])|[{space}]+")


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, spare = {b: chr(b) for b in shown}, 0
    for b in range(256):
        if b not in table:
            table[b] = chr(0x100 + spare)
            spare += 1
    return table


def prove_whole(definition: str) -> list[str]:
    """Vocabulary strings, as text, that the model's merges turn into exactly one token."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_str(definition).model
    to_byte = {c: b for b, c in byte_alphabet().items()}
    whole = []
    for token in json.loads(definition)["model"]["vocab"]:
        if any(c not in to_byte for c in token) or len(model.tokenize(token)) != 1:
            continue
        try:
            whole.append(bytes(to_byte[c] for c in token).decode())
        except UnicodeDecodeError:  # part of a character: never a pre-token
            continue
    return whole


class PieceCosts(dict):
    """Tokens of a pre-token: 1 for the proven ones, merged once for the rest."""

    def __init__(self, model, whole: list[str], remember: int):
        super().__init__(dict.fromkeys(whole, 1))
        self.model, self.most = model, len(whole) + remember
        self.shown = {b: c for b, c in byte_alphabet().items()}

    def __missing__(self, piece: str) -> int:
        n = len(self.model.tokenize(piece.encode().decode("latin-1").translate(self.shown)))
        if len(self) < self.most and len(piece) < 64:
            self[piece] = n
        return n


class Counter:
    """Counts of one vocabulary; built once per Python worker."""

    def __init__(self, definition: str, whole: list[str], remember: int = 300_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)
        spec = json.loads(definition)
        pre = spec.get("pre_tokenizer") or {}
        plain = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        added = spec.get("added_tokens", [])
        if not plain or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("the shortcut is proven for byte-level vocabularies without normalizer only")
        self.costs = PieceCosts(self.library.model, whole, remember)
        self.cut, self.odd = cutter(), re.compile(f"[^{char_class(lambda c: True)}]")
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, names))) if names else None

    def _plain(self, text: str) -> int:
        if self.odd.search(text):
            back = {c: b for b, c in byte_alphabet().items()}
            pieces = (bytes(back[c] for c in p).decode() for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text))
            return sum(map(self.costs.__getitem__, pieces))
        if len(text) > LIST_CHARS:
            return sum(self.costs[m.group()] for m in self.cut.finditer(text))
        return sum(map(self.costs.__getitem__, self.cut.findall(text)))

    def count(self, text: str) -> int:
        if self.added is None or not self.added.search(text):
            return self._plain(text)
        parts = self.added.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


_COUNTERS: dict[int, Counter] = {}


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for every row of ``docs``.

    ``vocabulary`` is the path of a byte-level BPE file on the driver; executors
    get its content (fixed by the vocabulary, about 2 MB), not the path.
    """
    with open(vocabulary, encoding="utf-8") as f:
        definition = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((definition, prove_whole(definition)))

    @F.pandas_udf(LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        key = hash(shared.value[0])
        if key not in _COUNTERS:
            _COUNTERS[key] = Counter(*shared.value)
        counter = _COUNTERS[key]
        for texts in batches:
            yield pd.Series([counter.count(t) for t in texts], dtype="int64")

    text = text_or_empty()
    return docs.select(
        "doc_id",
        F.octet_length(text).cast("long").alias("n_bytes"),
        count(text).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
