"""Fill-in-middle transformation by an Aho-Corasick event scan.

A text's units are runs of words with the white space before them, and white space at its end.
One automaton finds the only places that matter: the ASCII characters that change the class (white
space) and the sentinels.  Between two white-space events lies one word or nothing, so unit ends
are the events after a gap, and the k-th unit's end is looked up by its rank among them; no
character between events is looked at in Python.  Texts are scanned in blocks, joined by a blank
that no text's units cross, so memory follows the block or the longest single text.

Which rows are transformed, and where they are cut, comes from the SHA-256 of a seed and the
doc_id, so it is the same each time and however the rows are parted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm._words import blocks

#: White space: what separates words.
BLANKS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Sentinels:
    """Marks before the prefix, the suffix and the middle; texts that contain one stay plain.

    A mark's first character may be in marks at their start only, and no mark may begin another, so
    that a text and a mark beside it never make a mark between them.
    """

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = (self.prefix, self.suffix, self.middle)
        later = set("".join(m[1:] for m in marks)) | set(BLANKS)
        if not all(marks) or any(m[0] in later for m in marks) or any(a.startswith(b) for a in marks for b in marks if a is not b):
            raise ValueError("sentinels must be distinct, begin with a character that they don't have later on, and not begin each other")
        if set("".join(marks)) & set(BLANKS):
            raise ValueError("sentinels must not have white space")


def automaton(marks: Sentinels):
    """Matches a white-space character as 0 and the sentinels as 1, 2 and 3."""
    import ahocorasick

    out = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for c in BLANKS:
        out.add_word(c, 0)
    for i, mark in enumerate((marks.prefix, marks.suffix, marks.middle), 1):
        out.add_word(mark, i)
    out.make_automaton()
    return out


def events(scan, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Last code point and kind of each match, ascending by place."""
    found = np.fromiter((x for pair in scan.iter(text) for x in pair), np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


class Units:
    """Units of a list of texts, from the events of one scan."""

    def __init__(self, scan, texts: list[str]):
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.end = np.cumsum(size + 1) - 1
        self.start = self.end - size
        place, kind = events(scan, "\n".join([*texts, ""]))
        blank = place[kind == 0]
        gap = np.diff(blank, prepend=-1) > 1
        #: Where words end; a text's own are those from ``first`` to ``last``.
        self.stops = blank[gap]
        self.first = np.searchsorted(self.stops, self.start - 1, "right")
        self.last = np.searchsorted(self.stops, self.end, "right")
        # a text that ends with white space has one unit more
        at = np.searchsorted(blank, self.end - 1)
        self.more = (size > 0) & (blank[at] == self.end - 1)
        self.count = self.last - self.first + self.more
        marked = np.searchsorted(self.end, place[kind > 0])
        self.marked = np.zeros(len(texts), bool)
        self.marked[marked] = True

    def ends(self, k: np.ndarray) -> np.ndarray:
        """How many code points of each text its first ``k`` units have."""
        at = np.minimum(self.first + k - 1, np.maximum(len(self.stops) - 1, 0))
        inner = self.stops[at] if len(self.stops) else np.zeros(len(k), np.int64)
        place = np.where(k <= self.last - self.first, inner, self.end)
        return np.where(k > 0, place - self.start, 0)


def _draws(seed: int, key: int | None) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def arranged(form: str, prefix: str, middle: str, suffix: str, marks: Sentinels) -> str:
    if form == "psm":
        return f"{marks.prefix}{prefix}{marks.suffix}{suffix}{marks.middle}{middle}"
    return f"{marks.suffix}{suffix}{marks.prefix}{prefix}{marks.middle}{middle}"


def _transformed(seed: int, percent: int, spm_percent: int, marks: Sentinels):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = automaton(marks)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for i, j in blocks(texts):
                units = Units(scan, texts[i:j])
                draws = np.array([_draws(seed, k) for k in keys[i:j]], np.int64)
                cut = np.sort(draws[:, :2] % (units.count + 1)[:, None], axis=1)
                a, b = units.ends(cut[:, 0]).tolist(), units.ends(cut[:, 1]).tolist()
                plain = (units.count == 0) | units.marked | (draws[:, 2] % 100 >= percent)
                forms = np.where(plain, "plain", np.where(draws[:, 3] % 100 < spm_percent, "spm", "psm")).tolist()
                out = [t if f == "plain" else arranged(f, t[:x], t[x:y], t[y:], marks) for t, f, x, y in zip(texts[i:j], forms, a, b)]
                chars = [[None if f == "plain" else n for f, n in zip(forms, c)] for c in (a, [y - x for x, y in zip(a, b)])]
                columns = [pa.array(keys[i:j], pa.int64()), pa.array(units.count), pa.array(forms), *(pa.array(c, pa.int64()) for c in chars), pa.array(out, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def fill_in_middle(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80, marks: Sentinels = Sentinels()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every row of ``docs`` (doc_id, text).

    n is the number of units.  About ``percent`` of 100 rows get a form other than ``plain``, and of
    these ``spm_percent`` the form ``spm`` (suffix first), the others ``psm``.  Empty texts and those
    that contain a sentinel stay plain, as they are.  A null text is an empty one.  A null doc_id is
    drawn for as if it had no digits.  Rows are taken one by one, so repeated ones give equal rows; an
    empty table gives an empty result; other columns are ignored.  Whole texts are scanned.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_transformed(seed, percent, spm_percent, marks), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(scan, output: str, form: str, marks: Sentinels) -> str:
    """The text that ``output`` was made of; an error if it isn't of that form."""
    if form == "plain":
        return output
    place, kind = events(scan, output)
    place, kind = place[kind > 0].tolist(), kind[kind > 0].tolist()
    if kind != ([1, 2, 3] if form == "psm" else [2, 1, 3]) or place[0] != len((marks.prefix, marks.suffix)[kind[0] - 1]) - 1:
        raise ValueError(f"an output of form {form} must have its three sentinels once each, the first at its start")
    names = (marks.prefix, marks.suffix, marks.middle)
    parts = [output[p + 1 : q - len(names[k - 1]) + 1] for p, q, k in zip(place, place[1:], kind[1:])]
    prefix, suffix = parts if form == "psm" else parts[::-1]
    return prefix + output[place[2] + 1 :] + suffix


def restore(outputs: DataFrame, marks: Sentinels = Sentinels()) -> DataFrame:
    """The columns of ``outputs`` (with output and form) and restored, the text before it was transformed.

    A column called restored is replaced.  Null outputs give null.
    """
    kept = [c for c in outputs.columns if c.lower() != "restored"]
    # mapInArrow takes a dot in a name for a field, so the columns have names of their own meanwhile
    held = [f"kept{i}" for i in range(len(kept))]
    at = {n: next(i for i, c in enumerate(kept) if c.lower() == n) for n in ("output", "form")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = automaton(marks)
        for batch in batches:
            outs, forms = (batch.column(at[n]).to_pylist() for n in ("output", "form"))
            for i, j in blocks(outs):
                texts = [None if o is None else restored(scan, o, f, marks) for o, f in zip(outs[i:j], forms[i:j])]
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns), pa.array(texts, pa.string())], names=[*held, "restored"])

    rows = outputs.select(*(outputs[f"`{c.replace('`', '``')}`"].alias(h) for c, h in zip(kept, held)))
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("restored", T.StringType())])).toDF(*kept, "restored")
