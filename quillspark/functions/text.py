"""Cleaning, tokens and light stems as Column expressions, and as small helpers for tasks that have texts in Python anyway."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.stopwords import DEFAULT

#: All white space that a Unicode-aware split knows, spelled out: engines' own classes differ.
WHITE = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
#: The runs of white space that aren't a single blank already, which most are; what follows (?! leaves out most characters by one comparison.
_RUNS = rf"(?![!-~])(?:{WHITE[:-1].replace('x{20}', 'x{1f}')}{WHITE[:-1]}*| {WHITE})"
NOT_WORD = r"[^\p{L}\p{N}_]"
_NOT_TEXT = r"(?![a-z ])[^\p{L}\p{N}_ ]"


def clean(c: Column) -> Column:
    """White space collapsed to single blanks and trimmed; null becomes ''."""
    return F.coalesce(F.trim(F.regexp_replace(c, _RUNS, " ")), F.lit(""))


def _ends(w: Column, suffix: str) -> Column:
    return F.endswith(w, F.lit(suffix))


def _but_last(w: Column, n: int) -> Column:
    return F.substr(w, F.lit(1), F.length(w) - F.lit(n))


def plural_stem(w: Column) -> Column:
    """sses -> ss, ies -> i, and a single final s goes."""
    return F.when(_ends(w, "sses"), _but_last(w, 2)).when(_ends(w, "ies"), _but_last(w, 2)).when(_ends(w, "s") & ~_ends(w, "ss"), _but_last(w, 1)).otherwise(w)


def action_stem(w: Column) -> Column:
    """-ing (6 letters or more) or else -ed (5 or more) goes if a vowel is left."""
    left = lambda n: _but_last(w, n).rlike("[aeiou]")
    return F.when(_ends(w, "ing"), F.when((F.length(w) >= 6) & left(3), _but_last(w, 3)).otherwise(w)).when(_ends(w, "ed") & (F.length(w) >= 5) & left(2), _but_last(w, 2)).otherwise(w)


def undouble(w: Column) -> Column:
    """A doubled last character goes, but for vowels and ll, ss, ff."""
    last = F.right(w, F.lit(1))
    twice = (F.length(w) >= 2) & (last == F.substr(w, F.length(w) - F.lit(1), F.lit(1)))
    return F.when(twice & ~last.isin(*"aeioulsf"), _but_last(w, 1)).otherwise(w)


def stem(w: Column) -> Column:
    """Words of up to three characters stay."""
    return F.when(F.length(w) <= 3, w).otherwise(undouble(action_stem(plural_stem(w))))


def with_stems(rows: DataFrame, word: str = "word", name: str = "term") -> DataFrame:
    """``rows`` with the stem of a column of words.

    A column for each step: as one expression each step repeats the ones before in every place that it uses the
    word, and the code that Spark makes of it grows beyond 64 KB, so that it is interpreted instead.
    """
    first = rows.withColumn("_plural", plural_stem(F.col(word)))
    second = first.withColumn("_action", action_stem(F.col("_plural")))
    return second.withColumn(name, F.when(F.length(word) <= 3, F.col(word)).otherwise(undouble(F.col("_action")))).drop("_plural", "_action")


def bare(c: Column) -> Column:
    """Lower-case words without punctuation, parted by blanks, of which some may follow each other."""
    return F.regexp_replace(F.lower(clean(c)), _NOT_TEXT, "")


def words(c: Column, stop_words: Sequence[str] = DEFAULT) -> Column:
    """Lower-case words without punctuation and stop words.

    Case and punctuation are changed in the text as a whole, before it is split; the stop words
    are a hash set in the plan.
    """
    return F.filter(F.split(bare(c), " "), lambda w: (w != "") & ~w.isin(*stop_words) if stop_words else w != "")


def tokens(c: Column, stop_words: Sequence[str] = DEFAULT) -> Column:
    """The stems of a text's words; the same for documents and queries."""
    # one pass for each step, as a step uses its word many times; a blank shields short words from all of them
    first = F.transform(words(c, stop_words), lambda w: F.when(F.length(w) <= 3, F.concat(w, F.lit(" "))).otherwise(plural_stem(w)))
    second = F.transform(first, action_stem)
    return F.transform(second, lambda w: F.when(_ends(w, " "), _but_last(w, 1)).otherwise(undouble(w)))


def shingles(c: Column, k: int) -> Column:
    """The distinct substrings of ``k`` characters."""
    # characters as an array, bound once by the outer transform: a substring would count from the text's start
    grams = lambda ch: F.transform(F.sequence(F.lit(1), F.size(ch) - k + 1), lambda i: F.array_join(F.slice(ch, i, k), ""))
    cut = F.get(F.transform(F.array(F.split(c, "")), grams), F.lit(0))
    return F.when(F.length(c) >= k, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def prepared(c: Column) -> Column:
    """What ``plain`` takes: texts of the first 256 characters as they are, others by ``bare``, as engines may differ in those."""
    return F.when(c.rlike(r"[^\x00-\x{ff}]"), bare(c)).otherwise(F.coalesce(c, F.lit("")))


def _latin() -> tuple[bytes, bytes]:
    """Of the first 256 characters: what each becomes, and those that go."""
    white = {*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0}
    kept = lambda i: chr(i) == "_" or unicodedata.category(chr(i))[0] in "LN"
    return bytes(0x20 if i in white else ord(chr(i).lower()) for i in range(256)), bytes(i for i in range(256) if i not in white and not kept(i))


_BECOMES, _GOES = _latin()


def plain(prepared_text: str) -> str:
    """The words of a ``prepared`` text as ``bare`` gives them, stop words too."""
    try:
        return prepared_text.encode("latin-1").translate(_BECOMES, _GOES).decode("latin-1")
    except UnicodeEncodeError:
        return prepared_text


def stems(words: pa.Array) -> pa.Array:
    """``stem`` of each word."""
    size, ends, but_last = pc.utf8_length, pc.ends_with, lambda w, n: pc.utf8_slice_codeunits(w, 0, -n)
    vowel = lambda w: pc.match_substring_regex(w, "[aeiou]")
    one = pc.and_(ends(words, "s"), pc.invert(ends(words, "ss")))
    w = pc.if_else(pc.or_(ends(words, "sses"), ends(words, "ies")), but_last(words, 2), pc.if_else(one, but_last(words, 1), words))
    ing, ed = (pc.and_(pc.greater_equal(size(w), least), vowel(but_last(w, n))) for n, least in ((3, 6), (2, 5)))
    w = pc.if_else(ends(w, "ing"), pc.if_else(ing, but_last(w, 3), w), pc.if_else(pc.and_(ends(w, "ed"), ed), but_last(w, 2), w))
    last, before = pc.utf8_slice_codeunits(w, -1), pc.utf8_slice_codeunits(w, -2, -1)
    twice = pc.and_(pc.and_(pc.greater_equal(size(w), 2), pc.equal(last, before)), pc.invert(pc.is_in(last, pa.array(list("aeioulsf")))))
    return pc.if_else(pc.less_equal(size(words), 3), words, pc.if_else(twice, but_last(w, 1), w))
