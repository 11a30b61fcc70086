"""Each stage of the pipeline and run() against plain loops, on a table with nulls, repeats and clashing names."""

import random
import re
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from quillspark.llm import toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, w string, `a.b` int, score int, others string, found int"


def _table():
    r = random.Random(8)
    vocab = [f"word{i}" for i in range(700)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    base = [say(r.randint(60, 120)) for _ in range(12)]
    texts = [None, "", "too short", *base, base[0], base[1].upper(), "x y z " * 80, "# $ % " + say(20) + " & | #" * 30, "a line\n" * 40 + say(60)]
    texts += [t.replace(" word1", " other", 1) for t in base[2:5]]
    shared = say(70)
    texts += [say(60) + " " + shared + " " + say(60) for _ in range(4)]
    texts += [say(70) + " idiot scum" for _ in range(6)]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    rows += [(9, base[5]), (9, say(80)), (None, base[0]), (None, say(65))]  # repeated and null ids
    rows += [(1000 + i, say(60) + (" idiot scum" if i % 3 == 0 else "")) for i in range(120)]
    labels = [(1000 + i, 1, int(i % 3 == 0)) for i in range(120)]
    return [(i, t, "en", "s", None if t is None else len(t), "w", 7, 1, "o", 2) for i, t in rows], labels


ROWS, LABELS = _table()


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def bad(t):
    w = WORD.findall(t or "")
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    again = {k + d for k, g in enumerate(grams) if grams.count(g) > 1 for d in range(3)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    chars = sum(map(len, w))
    return (len(w) < 50 or 2 * len(again) > len(w) or 100 * len(re.findall(r"[#*$%&|<>]", t)) > 20 * len(w)
            or len(lines) > 3 and 2 * (len(lines) - len(set(lines))) > len(lines) or not 2 * len(w) <= chars <= 20 * len(w))


def fewest(rows):
    """Rows that stay of each group of near duplicates: those whose text is in a group with no smaller doc_id."""
    sets = []
    for i, t, *_ in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    own = [k for k, r in enumerate(rows) if r[0] is not None and sets[k]]
    for a in own:
        for b in own:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for k in own:
        least[find(k)] = min(least.get(find(k), rows[k][0]), rows[k][0])
    return [r for k, r in enumerate(rows) if k not in set(own) or r[0] == least[find(k)]]


def test_quality(spark, docs, sf):
    got = P.quality_stage(spark, docs, sf)
    assert got.columns == docs.columns
    assert plain(got) == sorted((r for r in ROWS if not bad(r[1])), key=repr)
    assert P.quality_stage(spark, docs.where("false"), sf).count() == 0


def test_toxicity(spark, docs, sf):
    got = P.toxicity_stage(spark, docs, sf)
    assert got.columns == docs.columns and got.schema["a.b"].dataType == docs.schema["a.b"].dataType
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    texts = [r[1] for r in ROWS]
    d, h, v = toxicity.word_terms([(t or "").encode() for t in texts])
    score = model(d, (h >> (64 - toxicity.BITS)).astype("int64"), v, len(texts))[0]
    assert plain(got) == sorted((r for r, s in zip(ROWS, score) if s < P.MOST_TOXIC), key=repr)
    assert not any("idiot" in (r[1] or "") for r in got.collect()) and len(plain(got)) == sum("idiot" not in (r[1] or "") for r in ROWS)
    assert P.toxicity_stage(spark, docs.where("false"), sf).count() == 0


def test_near_duplicates(spark, docs, sf):
    rows = [r for r in ROWS if r[0] is None or r[0] < 1000]
    some = docs.where("doc_id IS NULL OR doc_id < 1000")
    got = P.near_duplicate_stage(spark, some, sf)
    assert got.columns == docs.columns and plain(got) == sorted(fewest(rows), key=repr)
    assert P.near_duplicate_stage(spark, docs.where("false"), sf).count() == 0


def _without_repeats(rows):
    spans = {}
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - 49) if i is not None else []:
            s = tuple(w[k : k + 50])
            spans[s] = min(spans.get(s, i), i)
    out = []
    for i, t, lang, source, n, *more in rows:
        w = WORD.findall(t or "")
        gone = {k + d for k in range(len(w) - 49) if i is not None and spans[tuple(w[k : k + 50])] < i for d in range(50)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, kept if gone else t, lang, source, len(kept) if gone else n, *more))
    return out


def test_substring(spark, docs, sf):
    got = P.substring_stage(spark, docs, sf)
    assert got.columns == docs.columns and plain(got) == sorted(_without_repeats(ROWS), key=repr)
    assert P.substring_stage(spark, docs.where("false"), sf).count() == 0


def _encoder():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda x: [*t.encode(x or "", add_special_tokens=False).ids, 0]


def _packed(got, rows, capacity=2048):
    encode, ids, bins = _encoder(), {}, {}
    for r in got:
        assert r.length == len(r.ids) and zlib.crc32(b"".join(x.to_bytes(4, "little") for x in r.ids)) == r.ids_crc32
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    want = sorted(tuple(encode(t)) for t in rows)
    whole = sorted(tuple(r.ids) for r in got if r.length < capacity and r.piece == 0 and r.start == 0)
    assert whole == [x for x in want if len(x) < capacity] and sum(r.length for r in got) == sum(map(len, want))
    assert len(bins) <= -(-sum(map(len, want)) // capacity) + 1


def test_packing(spark, docs, sf):
    _packed(P.packing_stage(spark, docs, sf).collect(), [r[1] for r in ROWS])
    assert P.packing_stage(spark, docs.where("false"), sf).count() == 0


def test_run(spark, sf):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    got = P.run(spark, sf).collect()
    assert spark.conf.get(name, None) == before and P.ORACLE_SQL is None and [n for n, _ in P.STAGES][0] == "quality rules"
    rows = [r for r in ROWS if not bad(r[1]) and "idiot" not in (r[1] or "")]
    rows = _without_repeats(fewest(rows))
    _packed(got, [r[1] for r in rows])
    assert sorted(str(r.doc_id) for r in got if r.piece == 0) == sorted(str(r[0]) for r in rows)
