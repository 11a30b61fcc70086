"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is a name and a rejecting predicate over counts of a text.  The cascade measures each rule
on a bounded random sample (seconds it takes, share it rejects), orders the rules by rejections per
second, and evaluates them in one CASE, so a row stops at its first rejecting rule.  The order
never changes which rows are kept.

``passed`` needs the verdict alone: there the CASE holds the counts' own expressions, so a count
that only later rules need is not computed for a row that an earlier one rejects.  ``cascade``
returns the counts too, and so computes all of them for every row.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]+"


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def words(c: Column) -> Column:
    return F.array_remove(F.split(c, WHITE), "")


def n_symbols(c: Column) -> Column:
    return (F.size(F.split(c, r"[#*$%&|<>]", -1)) - 1).cast("long")


def lines(c: Column) -> Column:
    """The lines that have a word."""
    return F.filter(F.split(c, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def _windows(w: Column) -> Column:
    """64-bit hashes of each three consecutive words."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) >= 3, hashes).otherwise(F.array().cast("array<bigint>"))


#: Bits of a window's place in a sorted number; the others are the window's hash.
_PLACE = 22


def _covered(h: Column) -> Column:
    """Words in windows found twice or more, of the hashes of all windows.

    Windows are sorted as numbers of the upper bits of their hash and their place, which is much
    faster than as structs; neighbours are then compared by their whole hashes.
    """
    mask = (1 << _PLACE) - 1
    number = F.transform(h, lambda x, i: x.bitwiseAND(F.lit(-1 - mask)).bitwiseOR(i.cast("long")))
    place = lambda x: x.bitwiseAND(F.lit(mask)).cast("int")
    same = lambda x, y: (F.shiftright(x, _PLACE) == F.shiftright(y, _PLACE)) & (F.get(h, place(x)) == F.get(h, place(y)))
    again = lambda s: F.filter(s, lambda x, i: F.coalesce(same(F.get(s, i - 1), x), F.lit(False)) | F.coalesce(same(F.get(s, i + 1), x), F.lit(False)))
    places = bound(F.sort_array(number), lambda s: F.sort_array(F.transform(again(s), place)))
    # more windows than places have bits for: structs
    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    long = lambda s: F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
    places = F.when(F.size(h) <= mask, places).otherwise(bound(pairs, lambda s: F.sort_array(F.transform(long(s), lambda x: x["i"]))))
    steps = lambda p: F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
    return F.aggregate(bound(places, steps), F.lit(0), lambda a, x: a + x)


def _repeats(w: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f(hashes of all windows, how many of them equal an earlier one)"""
    return bound(_windows(w), lambda h: bound(F.size(h) - F.size(F.array_distinct(h)), lambda n: f(h, n)))


def n_repeat_words(w: Column) -> Column:
    """Words in three-word windows that the text has twice or more; windows are sorted only if one is."""
    return _repeats(w, lambda h, n: F.when(n > 0, _covered(h)).otherwise(F.lit(0))).cast("long")


def repeats_most(w: Column) -> Column:
    """100 * n_repeat_words > 50 * n_words.

    A window found c times counts at most 3 * c <= 6 * (c - 1) words, so few repeats decide without sorting.
    """
    return _repeats(w, lambda h, n: F.when(600 * n <= 50 * F.size(w), F.lit(False)).otherwise(100 * _covered(h) > 50 * F.size(w)))


def _dup_lines(ls: Column) -> Column:
    return (F.size(ls) - F.size(F.array_distinct(ls))).cast("long")


def _mostly_dup_lines(t: Column) -> Column:
    """More than 3 lines, of which more than half equal an earlier one; texts of up to 3 lines need no closer look."""
    found = bound(lines(t), lambda ls: (F.size(ls) > 3) & (100 * _dup_lines(ls) > 50 * F.size(ls)))
    return F.when(F.size(F.split(t, "\n", -1)) <= 3, F.lit(False)).otherwise(found)


def _odd_lengths(w: Column) -> Column:
    return bound(F.length(F.array_join(w, "")), lambda n: ~n.between(2 * F.size(w), 20 * F.size(w)))


#: name: expression over a text, its words and its lines
COUNTS: dict[str, Callable[[Column, Column, Column], Column]] = {
    "n_words": lambda t, w, ls: F.size(w).cast("long"),
    "word_chars": lambda t, w, ls: F.length(F.array_join(w, "")).cast("long"),
    "n_symbols": lambda t, w, ls: n_symbols(t),
    "n_lines": lambda t, w, ls: F.size(ls).cast("long"),
    "n_dup_lines": lambda t, w, ls: _dup_lines(ls),
    "n_repeat_words": lambda t, w, ls: n_repeat_words(w),
}

#: Gives a count by its name.
Counts = Callable[[str], Column]


@dataclass(frozen=True)
class Rule:
    """``shortly``, of a text and its words, says the same as ``rejects`` with less work."""

    name: str
    rejects: Callable[[Counts], Column]
    shortly: Callable[[Column, Column], Column] | None = None


def _few_words(c: Counts) -> Column:
    return c("n_words") < 50


def _repeated_windows(c: Counts) -> Column:
    return 100 * c("n_repeat_words") > 50 * c("n_words")


def _duplicate_lines(c: Counts) -> Column:
    return (c("n_lines") > 3) & (100 * c("n_dup_lines") > 50 * c("n_lines"))


def _word_length(c: Counts) -> Column:
    return ~c("word_chars").between(2 * c("n_words"), 20 * c("n_words"))


#: Thresholds on the counts.
RULES = [
    Rule("few_words", _few_words),
    Rule("repeated_windows", _repeated_windows, lambda t, w: repeats_most(w)),
    Rule("symbols", lambda c: 100 * c("n_symbols") > 20 * c("n_words")),
    Rule("duplicate_lines", _duplicate_lines, lambda t, w: _mostly_dup_lines(t)),
    Rule("word_length", _word_length, lambda t, w: _odd_lengths(w)),
]


def _spare(docs: DataFrame, name: str) -> str:
    """A name that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _column(docs: DataFrame, name: str) -> Column:
    return docs[f"`{name.replace('`', '``')}`"]


def with_base_counts(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words added.

    Windows are compared by 64-bit hashes of their words.  ``prefix`` goes before the new names;
    columns of ``docs`` with such a name are replaced, all others stay.  Null and empty texts have 0 in all.
    """
    t, held = _text(_column(docs, text)), _spare(docs, "base_counts")
    every = bound(words(t), lambda w: bound(lines(t), lambda ls: F.struct(*(f(t, w, ls).alias(c) for c, f in COUNTS.items()))))
    new = {f"{prefix}{c}".lower() for c in COUNTS}
    rows = docs.select(*(_column(docs, c) for c in docs.columns if c.lower() not in new), every.alias(held))
    return rows.select(*(_column(rows, c) for c in rows.columns if c != held), *(F.col(held)[c].alias(f"{prefix}{c}") for c in COUNTS))


def base_failed(c: Counts) -> Column:
    return _few_words(c) | _repeated_windows(c)


def first_rejection(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that rejects a row, or null.  CASE evaluates no rule after it."""
    out = None
    for name, rejects in rules:
        out = F.when(rejects, F.lit(name)) if out is None else out.when(rejects, F.lit(name))
    return out if out is not None else F.lit(None).cast("string")


def _judged(docs: DataFrame, rules: list[Rule], text: str) -> Column:
    """The name of the first rejecting rule, from the text itself."""
    t = _text(_column(docs, text))
    own = lambda r, w: r.shortly(t, w) if r.shortly else r.rejects(lambda c: COUNTS[c](t, w, lines(t)))
    return bound(words(t), lambda w: first_rejection([(r.name, own(r, w)) for r in rules]))


def sampled(docs: DataFrame, text: str, rows: int, seed: int = 11) -> DataFrame:
    """About ``rows`` random texts of the whole table, written once, in one partition."""
    share = min(1.0, rows / max(1, docs.count()))
    some = docs.select(_text(_column(docs, text)).alias("text"))
    return (some.sample(share, seed) if share < 1 else some).repartition(1)


def ordered(sample: DataFrame, rules: list[Rule]) -> list[tuple[Rule, float, float]]:
    """(rule, share of the sample it rejects, seconds it took), best rejections per second first.

    Each rule runs twice in one task, so that compiled code counts; what the sample's words and
    its reading take is taken off, as every rule has them.
    """

    def run(rules: list[Rule]) -> tuple[float, float]:
        best, share = float("inf"), 0.0
        for _ in range(2):
            began = time.perf_counter()
            share = sample.agg(F.avg(_judged(sample, rules, "text").isNotNull().cast("double"))).first()[0] or 0.0
            best = min(best, time.perf_counter() - began)
        return share, best

    _, least = run([Rule("none", lambda c: c("n_words") < 0)])
    found = [(rule, share, max(seconds - least, 1e-3)) for rule in rules for share, seconds in [run([rule])]]
    return sorted(found, key=lambda x: (-x[1] / x[2], x[2], x[0].name))


def _here() -> Column:
    """Always true, but not deterministic, so that a filter on the column is not moved below it.

    Moved, the filter would have each count's expression written out at each use.
    """
    return F.monotonically_increasing_id() >= 0


def _order(docs: DataFrame, text: str, rules: list[Rule] | None, sample_rows: int) -> list[Rule]:
    rules = RULES if rules is None else rules
    if len(rules) < 2:
        return rules
    sample = sampled(docs, text, sample_rows).persist()
    try:
        return [r for r, _, _ in ordered(sample, rules)]
    finally:
        sample.unpersist()


def cascade(docs: DataFrame, text: str = "text", prefix: str = "", rules: list[Rule] | None = None, sample_rows: int = 200) -> DataFrame:
    """``docs`` with the base counts, base_failed and kept (with ``prefix`` before each name).

    Costs and selectivities come from about ``sample_rows`` random rows; they decide the order
    alone.  Null texts count as empty and are rejected as too short.  Rows are judged one by one,
    so ties and repeats need no rule; an empty table gives an empty result.  Columns of ``docs``
    stay, but for those that have one of the new names.
    """
    rules = _order(docs, text, rules, sample_rows)
    out = with_base_counts(docs, text, prefix)
    counts: Counts = lambda c: F.col(f"`{prefix}{c}`")
    new = {f"{prefix}base_failed": base_failed(counts), f"{prefix}kept": first_rejection([(r.name, r.rejects(counts)) for r in rules]).isNull() & _here()}
    return out.select(*(_column(out, c) for c in out.columns if c.lower() not in {n.lower() for n in new}), *(x.alias(n) for n, x in new.items()))


def passed(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None, sample_rows: int = 200) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their columns as they are.

    The same rows as those with ``kept`` in ``cascade``, without its counts.
    """
    return docs.where(_judged(docs, _order(docs, text, rules, sample_rows), text).isNull())
