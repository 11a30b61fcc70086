"""Nulls, clashing names, crowded rows, broken input and models against plain loops."""

import bisect
import hashlib
import math
import random
import re
import struct
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillspark.llm import _terms, bpe, jaccard_join, license_scan, ogg, packing, quality_grade, quality_rules, sentence_pieces, substring_dedup, toxicity, url_filter
from quillspark.llm._cluster import checkpoint_dir

BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.fixture(scope="module")
def crowd(spark):
    """A third of the rows share a passage, a third are copies of one text."""
    r = random.Random(21)
    vocab = [f"w{i}" for i in range(3000)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    passage, text = say(60), say(90)
    rows = [(i, say(r.randint(5, 40)) + " " + passage + " " + say(r.randint(0, 150)) if i % 3 == 0 else text if i % 3 == 1 else say(80)) for i in range(600)]
    rows += [(700 + i, text.replace(" ", f" v{i} ", 1)) for i in range(60)] + [(None, text), (4, say(60)), (3, passage)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_crowded_tokens_change_no_link(spark, crowd, monkeypatch):
    rows, df = crowd
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for w in (t.split() for _, t in rows)]
    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if rows[a][0] is not None and rows[b][0] is not None and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
    _, crowds = jaccard_join.set_table(df)
    assert crowds.count() > 50  # the passage's shingles and the near copies'
    key = lambda r: (repr(r[0]), *r[1:])
    want = sorted((repr(i), len(s), n) for (i, _), s, n in zip(rows, sets, links))
    got = jaccard_join.link_counts(df, block=16).collect()
    assert sorted(key((r.doc_id, r.n_shingles, r.n_links)) for r in got) == want


def test_crowded_windows(spark, crowd):
    rows, df = crowd
    least = {}
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - 49) if i is not None else []:
            s = tuple(w[k : k + 50])
            least[s] = min(least.get(s, i), i)
    want = []
    for i, t in rows:
        w = t.split()
        gone = {k + d for k in range(len(w) - 49) if i is not None and least[tuple(w[k : k + 50])] < i for d in range(50)}
        want.append((repr(i), len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    got = substring_dedup.remove_repeats(df.withColumn("k", F.lit(1)).withColumn("places", F.lit(2))).collect()
    assert sorted((repr(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == sorted(want)
    # entries that reach the ranges: a few of each block of texts, not one for each row
    sent = df.select(F.xxhash64("doc_id", "text").alias("k"), "text").mapInArrow(substring_dedup._probe(25, 6), substring_dedup._SENT)
    size = sent.agg(F.sum(F.length("packed")).alias("n")).first().n
    words = sum(len(t.split()) for _, t in rows)
    assert size < 14 * words * 0.8
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(df.withColumn("kept", F.lit(1)), carry=["kept"])


def test_quality_counts_by_brute_force(spark):
    r = random.Random(2)
    vocab = ["a", "b", "été", "word", "longer", "#x", "*", "<b>"]
    texts = [None, "", "\n\n", "x", "a b c " * 700, "short\n" * 60]
    texts += ["".join(r.choice(vocab) + r.choice([" ", " ", " ", "\n", "\t", "  ", "\x0b"]) for _ in range(r.randint(0, 130))) for _ in range(120)]
    texts += [" ".join(f"u{r.randint(0, 10**6)}" for _ in range(n)) for n in (49, 50, 51, 3000)]
    rows = [(i, t, "w", 1, 2.0, "s") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, w string, l int, h double, s string").repartition(3)
    got = by_id(quality_rules.cascade(df))
    assert got[0].w == "w" and got[0].l == 1 and got[0].h == 2.0 and got[0].s == "s"
    kept = set()
    for i, t in enumerate(texts):
        t = t or ""
        w, row = WORD.findall(t), got[i]
        lines = [x for x in t.split("\n") if WORD.search(x)]
        grams, count = [tuple(w[k : k + 3]) for k in range(len(w) - 2)], {}
        for g in grams:
            count[g] = count.get(g, 0) + 1
        again = len({k + d for k, g in enumerate(grams) if count[g] > 1 for d in range(3)})
        chars, symbols, dup = sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines))
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == (len(w), chars, symbols, dup, again), i
        failed = len(w) < 50 or 100 * again > 50 * len(w)
        rejected = failed or 100 * symbols > 20 * len(w) or len(lines) > 3 and 2 * dup > len(lines) or not 2 * len(w) <= chars <= 20 * len(w)
        assert row.base_failed == failed and row.kept == (not rejected), i
        kept |= set() if rejected else {i}
    for rules in (quality_rules.RULES, quality_rules.RULES[::-1], quality_rules.RULES[2:] + quality_rules.RULES[:2]):
        shown = df.where(quality_rules._judged(df, list(rules), "text").isNull())
        assert {x.doc_id for x in shown.collect()} == kept
    assert {tuple(x) for x in quality_rules.passed(df).collect()} == {rows[i] for i in kept} and quality_rules.passed(df.where("false")).count() == 0


def test_license_matches_and_chains():
    r = random.Random(4)
    templates = [("x", "a b c d e f g h a b c d i j"), ("y", "c d e f k l m n"), ("z", "e f g h a b")]
    s = license_scan.Scanner(templates, {"a b": "base"}, shortest=3, gap=4)
    split = [t.split() for _, t in templates]
    for _ in range(300):
        words = [r.choice("abcdefghijklmnq") if r.random() < 0.2 else None for _ in range(40)]
        k = 0
        while k < 40:  # stretches of templates among single words
            t = r.choice(split)
            i = r.randrange(len(t))
            n = r.randint(1, 9)
            words[k : k + n] = t[i : i + n]
            k += max(1, min(n, len(t) - i)) + r.randint(0, 2)
        words = [w or "q" for w in words]
        w = license_scan.Words([" ".join(words).encode()], space=license_scan.NO_WORD)
        places, matches = s.scan([(first, numbers) for _, first, numbers in s.stretches(w)])
        assert sorted(p[1] for p in places) == [i for i in range(len(words) - 1) if words[i : i + 2] == ["a", "b"]]
        want = set()
        for t, own in enumerate(split):
            for i in range(len(words)):
                for e in range(len(own)):
                    if words[i] == own[e] and (i + 1 == len(words) or e + 1 == len(own) or words[i + 1] != own[e + 1]):
                        n = 1
                        while i >= n and e >= n and words[i - n] == own[e - n]:
                            n += 1
                        if n >= 3:
                            want.add((i - n + 1, i + 1, t + 1, e - n + 1))
        assert {(m.start, m.stop, m.template, m.place) for m in matches} == want
        for t, (share, _, _) in s.chains(matches).items():
            own = sorted(m for m in want if m[2] == t)
            best = 0
            for mask in range(1, 1 << len(own)) if len(own) <= 9 else []:
                chain, covered = [m for k, m in enumerate(own) if mask >> k & 1], 0
                for k, m in enumerate(chain):
                    size, both = m[1] - m[0], 0
                    if k:
                        p = chain[k - 1]
                        both = max(0, p[1] - m[0], p[3] + p[1] - p[0] - m[3])
                        if not (p[0] < m[0] and p[3] < m[3] and both < size and m[0] - p[1] <= 4):
                            covered = -99
                    covered += size - both
                best = max(best, covered)
            assert not best or abs(share - best / len(split[t - 1])) < 1e-9


def test_license_texts_with_strays(spark):
    whole = license_scan._MIT.split()
    q, h = len(whole) // 4, len(whole) // 2
    stray = whole[:q] + ["foreign"] + whole[q:h] + ["foreign"] + whole[:6] + whole[h:]
    swapped = [*whole[h:], *whole[:h]]
    texts = [" ".join(stray), " ".join(whole), " ".join(swapped), "permission is hereby granted", " ".join(license_scan.TEMPLATES[14][1].split()), None]
    got = by_id(license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_words", F.lit("x"))))
    assert got[0].labels == "mit" and got[0].score > 0.9 and got[1].labels == "mit" and got[1].score == 1.0
    assert got[2].score < 1 and got[3].labels == "" and got[3].n_base == 0 and got[4].labels and got[5].score == 0


def _varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _unigram(path, pieces, prefix=1, squeeze=0):
    """A model file of the unigram kind with bytes for what is no piece."""
    field = lambda k, x: _varint(k << 3 | 2) + _varint(len(x)) + x
    every = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256)), *((p, s, 1) for p, s in pieces)]
    out = b"".join(field(1, field(1, p.encode()) + b"\x15" + struct.pack("<f", s) + b"\x18" + _varint(k)) for p, s, k in every)
    trainer = b"\x18\x01" + b"\x20" + _varint(len(every)) + _varint(35 << 3) + b"\x01"
    normal = field(1, b"identity") + bytes([0x18, prefix, 0x20, squeeze]) + b"\x28\x01"
    path.write_bytes(out + field(2, trainer) + field(3, normal))
    return str(path)


@pytest.mark.parametrize("prefix,squeeze", [(1, 0), (1, 1), (0, 0), (0, 1)])
def test_unigram_ids_are_the_library_s(tmp_path, prefix, squeeze):
    """With and without a space in front, and with extra spaces kept or taken out, as models have by default."""
    from sentencepiece import SentencePieceProcessor

    r = random.Random(6)
    pieces = {"▁": -3.0} | {c: -4.0 - i / 7 for i, c in enumerate("abcdef")}
    while len(pieces) < 120:
        p = ("▁" if r.random() < 0.4 else "") + "".join(r.choice("abcdef") for _ in range(r.randint(1, 5)))
        pieces.setdefault(p, -r.uniform(3, 12))
    path = _unigram(tmp_path / "u.model", list(pieces.items()), prefix, squeeze)
    lib, own = SentencePieceProcessor(model_file=path), sentence_pieces.Pieces(path)
    texts = ["".join(r.choice("abcdef  é中") for _ in range(r.randint(1, 40))) for _ in range(1500)] + ["abcdef" * 300 + "é" + "fed" * 200, "a" * 1000, "ab  cd ", " ab", "   ", "", "a\tb\n c"]
    ids, n = own.encode(texts)
    same = 0
    for t, x in zip(texts, np.split(ids, np.cumsum(n)[:-1])):
        same += lib.encode(t) == x.tolist()
    assert own.decode(ids, n) == [lib.normalize(t).replace("▁", " ")[prefix:].encode() for t in texts] and (own.normalize is None) == (prefix > squeeze)
    assert same == len(texts), f"{same} of {len(texts)}"


def test_long_units_equal_short_ones(monkeypatch):
    model = sentence_pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    r = random.Random(9)
    texts = ["".join(r.choice("theandinguré中x") for _ in range(n)) for n in (1, 5, 60, 390)]
    want = model.encode(texts)[0].tolist()
    model.cache.clear()
    monkeypatch.setattr(sentence_pieces, "LONG", 3)
    monkeypatch.setattr(sentence_pieces, "_STRETCH", 17)
    assert model.encode(texts)[0].tolist() == want


def test_media_rows(spark):
    text = b"some words " * 400
    media = ogg.write(ogg.padded(text), len(text))
    streams = ogg.read(media)
    sound = next(s for s in streams.values() if s.packets[0].startswith(b"pcm8"))
    assert b"".join(sound.packets[1:])[: len(text)] == text and sound.pages > 2
    kinds = [media[i + 5] for i in range(len(media)) if media[i : i + 4] == b"OggS"]
    serials = [media[i + 14 : i + 18] for i in range(len(media)) if media[i : i + 4] == b"OggS"]
    assert any(k & ogg.CONTINUED for k in kinds) and len(set(serials)) == 2
    assert sum(a != b for a, b in zip(serials, serials[1:])) >= 4  # the streams lie between each other
    assert sound.seconds(ogg.RATE)[-1] == len(ogg.padded(text)) / ogg.RATE
    alone = ogg.page(ogg.FIRST | ogg.LAST, 0, 5, 0, b"", b"")
    rows = [(1, media), (2, None), (3, media[:-1]), (4, b""), (5, alone), (None, media)]
    got = ogg.read_media(spark.createDataFrame(rows, "doc_id long, media binary").withColumn("feature", F.lit(1)))
    out = {r.doc_id: r for r in got.collect()}
    assert out[1].error is None and out[1].n_bytes == len(text) and out[None].media_sha256 == hashlib.sha256(media).hexdigest()
    assert out[2].media_bytes is None and out[2].error is None and out[2].n_bytes is None
    assert all(out[i].error and out[i].n_bytes is None for i in (3, 4, 5)) and out[3].media_bytes == len(media) - 1
    assert ogg.read_media(got.select("doc_id", F.lit(None).cast("binary").alias("media")).where("false")).count() == 0


def test_scores_by_plain_loops(spark):
    r = np.random.default_rng(3)
    texts = [None, "", "Ends. *** Ends.", "one two three two", "x " * 2000, *(" ".join(r.choice(["idiot", "scum", "green", "hill", "walks", "walked"], 30)) for _ in range(20))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("a.b", F.lit("kept"))
    m, k = 50, 4
    slot = np.full(1 << toxicity.BITS, -1, np.int32)
    d, h, _ = _terms.word_terms([(t or "").encode() for t in texts])
    buckets = np.unique((h >> np.uint64(64 - toxicity.BITS)).astype(np.int64))[:m]
    slot[buckets] = np.arange(len(buckets))
    model = toxicity.FactorizationMachine(slot, np.array([-0.3]), r.normal(0, 1, m), r.normal(0, 0.5, (m, k)))
    got = by_id(toxicity.score_toxicity(df, model, ["doc_id", "a.b"]))
    for i in range(len(texts)):
        mine = sorted({int(slot[int(x) >> (64 - toxicity.BITS)]) for x, y in zip(h.tolist(), d.tolist()) if y == i} - {-1})
        z = model.bias[0] + sum(model.w[a] for a in mine) + sum(float(model.v[a] @ model.v[b]) for n, a in enumerate(mine) for b in mine[n + 1 :])
        assert abs(got[i].score - 1 / (1 + math.exp(-z))) < 1e-9 and got[i]["a.b"] == "kept"
    with pytest.raises(ValueError):
        toxicity.score_toxicity(df.withColumn("score", F.lit(1)), model, ["doc_id", "score"])
    grade = quality_grade.CumulativeLink(r.normal(0, 1, 1 << quality_grade.BITS), np.array([-0.5, 0.8]), 1)
    d, h, v = _terms.style_terms([(t or "").encode() for t in texts])
    shown = by_id(quality_grade.grade_quality(df.withColumn("kept", F.lit(1)), grade))
    for i in range(len(texts)):
        s = sum(grade.w[int(x) >> (64 - quality_grade.BITS)] * y for x, y, z in zip(h.tolist(), v.tolist(), d.tolist()) if z == i)
        tails = [1 / (1 + math.exp(t - s)) for t in grade.thresholds]
        assert abs(shown[i].expected_grade - sum(tails)) < 1e-9 and abs(shown[i].tail_prob - tails[0]) < 1e-9 and shown[i].kept == (tails[0] >= 0.5)
    assert toxicity.score_toxicity(df.where("false"), model).count() == 0 == quality_grade.grade_quality(df.where("false"), grade).count()


def test_sample_is_bounded(spark):
    docs = spark.range(3000).select((F.col("id") % 30).alias("doc_id"), F.concat(F.repeat(F.lit("word "), 200), F.col("id").cast("string")).alias("text"))
    labels = spark.range(30).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic"))
    assert _terms.labelled_sample(docs, labels, F.col("toxic"), 100).count() < 200
    small = _terms.labelled_sample(docs, labels, F.col("toxic"), 10_000, most_bytes=50_000)
    assert 0 < small.agg(F.sum(F.octet_length("text"))).first()[0] < 120_000
    assert sorted(small.collect()) == sorted(_terms.labelled_sample(docs.repartition(7), labels, F.col("toxic"), 10_000, most_bytes=50_000).collect())


def test_shares_are_exact_at_any_size(spark):
    """At a share of 1e-8 a table of many billions of rows still gives its sample."""
    edge = spark.range(2_000_000).select(F.shiftrightunsigned(F.xxhash64("id"), 2).alias("h"))
    for share in (1e-3, 1e-5):
        assert abs(spark.range(2_000_000).where(_terms.hash_share(share, "id")).count() - 2_000_000 * share) < 6 * (2_000_000 * share) ** 0.5 + 1
    least = edge.agg(F.min("h")).first()[0]
    assert spark.range(2_000_000).where(_terms.hash_share((least + 1024) / 2**62, "id")).count() == 1 and int(1e-8 * (1 << 62)) > 10**10


def test_cache_is_bounded_by_ids():
    cache = bpe.IdCache(1000, 50)
    for k in range(1, 40):
        h = np.arange(k * 100, k * 100 + 5).astype(np.uint64) + np.uint64(1)
        entry = cache.entries(h, lambda at: (np.full(len(at), 4), np.repeat(h[at], 4).astype(np.uint32)))
        assert cache.used <= 70 and (cache.ids[cache.at[entry]] == h).all()


def test_packing_at_full_capacity(spark):
    r = random.Random(1)
    texts = [None, "", "é" * 9000, *("word " * r.randint(1, 1900) for _ in range(60))]
    df = spark.createDataFrame([(i // 2, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    got = packing.pack(df, BPE, ids=True).collect()
    total, bins = sum(x.length for x in got), {}
    for x in got:
        assert len(x.ids) == x.length
        bins.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for parts in bins.values():
        assert sum(n for _, n in parts) <= 2048 and all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:]))
    assert len(bins) <= -(-total // 2048) * 11 / 9 + 1


def test_urls_of_an_empty_table_and_clashing_names(spark):
    rules = spark.createDataFrame([("com", "/", "block")], url_filter.RULES_SCHEMA)
    pages = spark.createDataFrame([(1, "http://x.com/a", "mine"), (1, "http://x.com/a", "mine"), (None, None, "mine")], "page_id int, url string, host string")
    assert sorted(r.verdict for r in url_filter.url_verdicts(pages, rules).collect()) == ["allow", "block", "block"]
    assert url_filter.url_verdicts(pages.where("false"), rules).count() == 0
    assert {r.verdict for r in url_filter.url_verdicts(pages, rules.where("false")).collect()} == {"allow"}


def test_urls_with_very_many_labels(spark):
    rules = spark.createDataFrame([("b.com", "/", "block"), ("com", "/", "allow"), ("", "", "block"), (".x", "", "block")], url_filter.RULES_SCHEMA)
    host = "a." * 100_000
    pages = spark.createDataFrame([(1, f"http://{host}b.com/p"), (2, f"http://{host}com/"), (3, host), (4, f"http://{host}.x/"), (5, f"http://{host}")], "page_id int, url string")
    assert {r.page_id: r.rule for r in url_filter.url_verdicts(pages, rules).collect()} == {1: "b.com/", 2: "com/", 3: "", 4: ".x", 5: ""}


def test_fewer_sequences_than_best_fit():
    r = np.random.default_rng(4)
    for n, make in ((4000, lambda n: r.integers(1, 2049, n)), (20_000, lambda n: np.clip(r.lognormal(6, 1, n), 1, 2048).astype(int)), (3000, lambda n: r.integers(400, 1025, n)), (60, lambda n: r.integers(1, 900, n))):
        x = make(n)
        free, bins = [], 0
        for size in sorted(x.tolist(), reverse=True):
            at = bisect.bisect_left(free, size)
            bins += at == len(free)
            bisect.insort(free, (free.pop(at) if at < len(free) else 2048) - size)
        found = packing.plan(Counter(x.tolist()), 2048)
        used = Counter()
        for times, parts in found:
            assert times > 0 and sum(a * b for a, b in parts) <= 2048
            used.update({a: b * times for a, b in parts})
        assert used == Counter(x.tolist()) and sum(t for t, _ in found) <= bins


def test_checkpoints_need_a_shared_folder():
    class Named:
        def isDefined(self):
            return False

    class Context:
        master = "spark://far:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: Named()})()})()

        def getConf(self):
            return {}

    with pytest.raises(ValueError):
        checkpoint_dir(type("Session", (), {"sparkContext": Context()})())
