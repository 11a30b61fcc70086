"""Fill-in-middle, decontamination and vector codes against plain loops, with nulls, ties, repeats and clashing names."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import decontamination, vector_codes
from quillspark.llm import fill_in_middle as fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _plain(key, text):
    """n, form, prefix_chars, middle_chars, output by the definition."""
    text, digest = text or "", hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    units = UNIT.findall(text)
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    pre, mid, suf = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def _texts():
    r = random.Random(8)
    parts = ["a", "word", "é", "😀", " ", "  ", "\n", "\t\v", "\x1c", "\x85", "<P", ">", "<", "\x00"]
    return [None, "", " ", "\n\n", "x", " x ", "has <S> in it", "<M>", "long " * 40_000] + ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(400)]


def test_fill_in_middle(spark):
    texts = _texts()
    rows = [(i // 2 * 2, t, "clash", i) for i, t in enumerate(texts)] + [(None, "a b c", "", 1), (7, "same text", "", 1), (7, "same text", "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, n int").repartition(5)
    out = fim.fill_in_middle(docs)
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    assert got == sorted(((k, *_plain(k, t)) for k, t, *_ in rows), key=repr) and {r[2] for r in got} == {"plain", "psm", "spm"}
    again = fim.restore(out.withColumn("a.b", F.lit(1)).withColumn("restored", F.lit("old")))
    assert again.columns == [*out.columns, "a.b", "restored"]
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.restored) for r in again.collect()) == sorted((-1 if k is None else k, t or "") for k, t, *_ in rows)
    assert fim.fill_in_middle(docs.where("false")).count() == 0 == fim.restore(out.where("false")).count()
    every = fim.fill_in_middle(docs, seed=1, percent=100, spm_percent=0).where("n > 0")
    assert {r.form for r in every.collect()} == {"plain", "psm"} and every.where("form = 'plain' AND NOT output RLIKE '<[PSM]>'").count() == 0


def test_units_of_blocks_and_outputs_that_are_refused(monkeypatch):
    with pytest.raises(ValueError):
        fim.Sentinels("<P>", "<P>x", "<M>")
    with pytest.raises(ValueError):
        fim.Sentinels("aba", "c", "d")
    with pytest.raises(ValueError):
        fim.Sentinels("< P>", "<S>", "<M>")
    marks = fim.Sentinels("<pre|", "<suf|", "<mid|")
    scan, r = fim.automaton(marks), random.Random(3)
    for t in (t for t in _texts() if t):
        a = r.randint(0, len(t))
        b = r.randint(a, len(t))
        for form in ("psm", "spm"):
            out = fim.arranged(form, t[:a], t[a:b], t[b:], marks)
            assert fim.restored(scan, out, form, marks) == t
            for wrong in (out[1:], out + marks.middle, out.replace(marks.suffix, "")):
                with pytest.raises(ValueError):
                    fim.restored(scan, wrong, form, marks)


def _contaminated(docs, items, span):
    words = lambda t: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    spans = {}
    for key, text in items:
        w = words(text)
        size = min(span, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            spans.setdefault(tuple(w[i : i + size]), set()).add(key)
    out = []
    for key, text in docs:
        w = words(text)
        hits = {(i, size): spans[tuple(w[i : i + size])] for size in {len(s) for s in spans} for i in range(len(w) - size + 1) if tuple(w[i : i + size]) in spans}
        hit = {i + k for i, size in hits for k in range(size)}
        ids = sorted({str(x) for s in hits.values() for x in s if x is not None})
        out.append((key, len(w), len(hit), tuple(ids), tuple(sorted(hits))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("span,most", [(10, 500_000), (10, 0), (4, 0), (1, 500_000), (2, 500_000), (3, 500_000)])
def test_decontamination(spark, span, most):
    r = random.Random(span)
    vocab = [f"w{i}" for i in range(30)] + ["É", "é", "x_y", "don't", "日本"]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, say(r.randint(10, 30))) for i in range(20)] + [(100, None), (101, ""), (102, "?!"), (5, say(12)), (None, say(15)), (103, "a a a a a a a a a a a a a"), (104, "a a a a a a a a a a"), (105, "Zweig"), (106, "one two THREE four"), (107, "w1 w2")]
    items += items[:2]
    docs = [(0, None), (1, ""), (2, "..."), (3, "a " * 50 + "b"), (4, "zweig"), (5, "One, two; three-FOUR one"), (6, "a " * 9)]
    for i in range(60):
        w = say(r.randint(0, 40)).split()
        t = (r.choice(items)[1] or "").split()
        at = r.randint(0, len(w))
        cut = r.randint(0, max(0, len(t) - 9))
        docs.append((10 + i // 2, " ".join([*w[:at], *t[cut : cut + r.randint(5, 14)], *w[at:]]).upper().replace(" ", r.choice([" ", ", ", "\n"]))))
    docs += [(None, items[0][1]), (7, items[1][1]), (7, items[1][1])]
    d = spark.createDataFrame([(*x, "clash", 1) for x in docs], "doc_id long, text string, item_id string, w int").repartition(4)
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int").repartition(2)
    got = decontamination.find_contamination(d, b, span, most)
    want = _contaminated(docs, items, span)
    assert sorted(((x.doc_id, x.n_words, x.n_hit, tuple(x.item_ids), tuple((h.start, h.length) for h in x.hits)) for x in got.collect()), key=repr) == want
    if span == 10:
        assert decontamination.find_contamination(d.where("false"), b, span, most).count() == 0
        none = decontamination.find_contamination(d, b.where("false"), span, most)
        assert none.count() == len(docs) and none.agg(F.sum("n_hit")).first()[0] == 0


def test_decontamination_runs_no_python(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = decontamination.find_contamination(d, d.withColumnRenamed("doc_id", "item_id"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_letters_beyond_ascii_stay(spark):
    texts = ["ABC İı ÀÉ Σ", "ABC éı", "K", "", "ΑΣ"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(decontamination.lower_ascii(F.col("t"))).collect()
    assert [r[0] for r in got] == [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in texts]


@pytest.mark.parametrize("size", [1, 2, 3, 8, 13])
def test_nearest_entries(size):
    r = np.random.default_rng(size)
    for scale in (3, 1000, 1 << 27):
        x, book = (r.integers(-scale, scale + 1, (n, size)) for n in (700, 16))
        book[5] = book[3]
        x[:50] = book[r.integers(0, 16, 50)]
        d = ((x[:, None, :] - book[None]) ** 2).sum(2)
        entry, distance = vector_codes.nearest(x, book)
        assert (distance == d.min(1)).all() and (entry == d.argmin(1)).all()
    flat = np.full((20, size), 7)
    assert (vector_codes.nearest(flat, flat[:4])[0] == 0).all()


def _coded(rows, dims, parts=8, entries=16, rounds=6):
    kept = [(k, label, np.floor(np.array(v, float) * 4096).astype(int).tolist()) for k, label, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    size = dims // parts
    first = sorted(((k, np.array(v, "<i4").tobytes(), v) for k, _, v in kept if k is not None))[:entries]
    books = [[v[p * size : (p + 1) * size] for _, _, v in first] for p in range(parts)]
    near = lambda p, v: min((sum((a - b) ** 2 for a, b in zip(v[p * size : (p + 1) * size], c)), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        held = [[[] for _ in b] for b in books]
        for _, _, v in kept:
            for p in range(parts):
                held[p][near(p, v)[1]].append(v[p * size : (p + 1) * size])
        books = [[[sum(c) // len(h) for c in zip(*h)] if h else old for h, old in zip(held[p], books[p])] for p in range(parts)]
    out = [(k, label, "".join(f"{near(p, v)[1]:02x}" for p in range(parts)), sum(near(p, v)[0] for p in range(parts))) for k, label, v in kept]
    sums = {}
    for _, label, _, e in out:
        sums[label] = sums.get(label, 0) + e
    text = ",".join(str(x) for b in books for c in b for x in c)
    return sorted(((*o, sums[o[1]]) for o in out), key=repr), hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("n,dims", [(120, 16), (120, 8), (5, 24)])
def test_vector_codes(spark, monkeypatch, n, dims):
    monkeypatch.setattr(vector_codes, "BLOCK", 50)
    r = np.random.default_rng(n + dims)
    rows = [(int(k), int(k) % 3 if k % 7 else None, [float(np.float32(x)) for x in r.standard_normal(dims)]) for k in r.permutation(n)]
    rows += [(3, 1, rows[0][2]), (3, 1, rows[0][2]), (None, 2, rows[1][2]), (-5, None, None), (-4, 1, [None] * dims), (-3, 1, [float("nan")] * dims), (-2, 1, [1.0] * (dims - 1) + [float("inf")]), (-1, 1, [])][:7]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "vec_id long, label int, vector array<float>, code string").repartition(4)
    coded, books = vector_codes.compress(df)
    want, digest = _coded(rows, dims)
    got = vector_codes.with_label_errors(coded)
    assert sorted((tuple(x) for x in got.collect()), key=repr) == want and vector_codes.codebooks_digest(books) == digest
    none, books = vector_codes.compress(df.where("false"))
    assert vector_codes.with_label_errors(none).count() == 0 and books.size == 0
    with pytest.raises(ValueError):
        vector_codes.compress(df, parts=dims - 1)
    with pytest.raises(Exception, match="components"):
        vector_codes.compress(df.union(spark.createDataFrame([(1, 1, [1.0], "")], df.schema)))
    with pytest.raises(Exception, match="no exact distances"):
        vector_codes.compress(df.union(spark.createDataFrame([(1, 1, [1e30] * dims, "")], df.schema)))
