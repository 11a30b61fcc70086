"""Each operator against a brute-force version, on small tables with nulls, empty and repeated texts."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspark.llm import bpe, jaccard_join, license_scan, ogg, packing, quality_grade, quality_rules, sentence_pieces, substring_dedup, toxicity, url_filter
from quillspark.llm.components import connected_components

BPE, SPM = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _texts():
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    base = [[r.choice(vocab) for _ in range(r.randint(60, 160))] for _ in range(25)]
    out = [None, "", " \n\t", "One two", "one TWO", "É x", "licensed under the MIT License. mit license"]
    for b in base:
        out.append(" ".join(b))
        for _ in range(2):
            c = list(b)
            for _ in range(r.randint(0, 4)):
                c[r.randrange(len(c))] = r.choice(vocab)
            out.append(" ".join(c).replace("w1", "W1"))
    shared = " ".join(base[0][:70])
    out += ["<|endoftext|>", "left  <|endoftext|><|endoftext|>\n right <|endoftext|"]
    out += [shared + " " + " ".join(r.choice(vocab) for _ in range(40)) for _ in range(6)]
    return out + ["a b c\na b c\na b c\n" * 30, "x " * 3000]


TEXTS = _texts()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i * 3, t, "clash", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, k string, n_words int").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def best_fit_decreasing(lengths, capacity):
    free = []
    for n in sorted(lengths, reverse=True):
        at = min((i for i, f in enumerate(free) if f >= n), key=lambda i: free[i], default=None)
        if at is None:
            free.append(capacity - n)
        else:
            free[at] -= n
    return len(free)


def test_packing(spark, docs, empty):
    got = packing.pack(docs, BPE, capacity=64).collect()
    library = Tokenizer.from_file(BPE)
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(TEXTS):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for r in sorted(pieces[i * 3], key=lambda r: r.piece):
            assert r.start == at and zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32 and (r.length == 64 or r.piece == 0)
            at += r.length
        assert at == len(ids)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 64
    assert len(bins) <= best_fit_decreasing([r.length for r in got], 64)
    assert packing.pack(empty, BPE).count() == 0


def test_pretokens_equal_the_library():
    enc, library = bpe.Encoder(BPE), Tokenizer.from_file(BPE)
    r = random.Random(1)
    parts = ["a", "s", "t", "re", "ll", "ve", "'", " ", "  ", "\n", "\t", "1", "é", "!", "中", "😀", "<|endoftext|>", "\x85"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(3000)]
    ids, n = enc.encode(texts)
    for t, own in zip(texts, np.split(ids, np.cumsum(n)[:-1])):
        assert library.encode(t, add_special_tokens=False).ids == own.tolist(), t
    assert enc.encode(["a<|endoftext|>b"])[0].tolist() == [64, 50256, 65]


def test_near_duplicates(docs, empty):
    sets = {}
    for i, t in enumerate(TEXTS):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i * 3] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = by_id(jaccard_join.near_duplicates(docs))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(s), find(i)) for i, s in sets.items()}
    assert jaccard_join.near_duplicates(empty).count() == 0


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 50 + i) for i in range(30)] + [(7, 7), (200, 201)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long").repartition(5)).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[i] == 50 for i in [*range(51, 80), 100]) and got[201] == 200


def test_grades_and_toxicity(spark):
    r = random.Random(5)
    good = lambda: " ".join(r.choice("the of and river stone cloud walks over green hill".split()) for _ in range(80))
    rows = []
    for i in range(600):
        t, kind = good(), i % 3
        rows.append((i, t.replace(" ", "### ") if kind == 0 else t + " idiot scum" if kind == 1 else t, int(kind != 0), int(kind == 1)))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    more = df.select("doc_id", "text").union(spark.createDataFrame([(1000, None), (1001, "")], "doc_id long, text string"))
    model = quality_grade.train(df, df, F.col("quality") * (F.lit(2) - F.col("toxic")))
    assert (np.diff(model.thresholds) > 0).all()
    got = by_id(quality_grade.grade_quality(more, model))
    assert all(got[i].kept == bool(q) for i, _, q, _ in rows if got[i].held_out) and len(got) == 602
    scores = by_id(toxicity.score_toxicity(more, toxicity.train(df, df)))
    assert all((scores[i].score >= 0.7) == bool(x) for i, _, _, x in rows) and 0 <= scores[1000].score == scores[1001].score <= 1
    assert toxicity.score_toxicity(more, toxicity.train(df, df.where("false"))).count() == 602


def test_factors_learn_a_pair():
    r = np.random.default_rng(2)
    x = r.integers(0, 2, (2000, 2))
    row, col = np.nonzero(np.hstack([x, np.ones((2000, 1), int)]))
    sample = {"label": x[:, 0] & x[:, 1], "row": row, "bucket": col.astype(np.int32), "value": np.ones(len(row))}
    model = toxicity.fit(sample, least_z=0, epochs=400)
    score = lambda *b: model(np.zeros(len(b), int), np.array(b), np.ones(len(b)), 1)[0][0]
    assert score(0, 1, 2) > 0.9 and max(score(0, 2), score(1, 2), score(2)) < 0.1
    assert abs(model.v[0] @ model.v[1]) > 0.1


def test_license_scan(docs, empty):
    got = by_id(license_scan.scan_licenses(docs))
    r = got[18]
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == (7, 2, 3, 5, "mit", "mit", 1.0)
    assert got[0].n_words == 0 and got[0].first_word is None and got[0].labels == ""
    assert license_scan.scan_licenses(empty).count() == 0


def test_automaton():
    r = random.Random(5)
    for _ in range(100):
        seqs = [[r.randint(0, 3) for _ in range(r.randint(1, 8))] for _ in range(3)]
        text = [r.randint(0, 4) for _ in range(20)]
        subs = {tuple(s[a:b]) for s in seqs for a in range(len(s)) for b in range(a + 1, len(s) + 1)} | {()}
        for i, (_, n) in enumerate(license_scan.Automaton(seqs).statistics(text)):
            assert n == max(k for k in range(i + 2) if tuple(text[i + 1 - k : i + 1]) in subs)


def test_substring_dedup(docs, empty):
    seen, want = {}, {}
    for i, t in enumerate(TEXTS):
        w = WORD.findall(t or "")
        spans = [tuple(w[k : k + 50]) for k in range(len(w) - 49)]
        gone = {k + d for k, s in enumerate(spans) if seen.get(s, i) < i for d in range(50)}
        for s in spans:
            seen.setdefault(s, i)
        want[i * 3] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 0
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_sentence_pieces(docs):
    model = sentence_pieces.Pieces(SPM)
    score = dict(zip(model.ids.tolist(), model.scores.tolist()))
    from sentencepiece import SentencePieceProcessor

    lib = SentencePieceProcessor(model_file=SPM)
    for word in ("hello", "therefore", "running", "a", "éé", "中x", "ingly" * 4):
        text = "▁" + word
        best = [(0.0, [])] + [None] * len(text)
        for j in range(1, len(text) + 1):
            options = []
            for i in range(max(0, j - 16), j):
                k = lib.piece_to_id(text[i:j])
                if k in score:
                    options.append((best[i][0] + score[k], i, [k]))
                elif j - i == 1:
                    options.append((best[i][0] + model.unknown, i, model.byte[np.frombuffer(text[i:j].encode(), np.uint8)].tolist()))
            s, i, ids = max(options, key=lambda o: (o[0], -o[1]))
            best[j] = (s, best[i][1] + ids)
        assert model.encode([word])[0].tolist() == best[-1][1], word
    texts = by_id(sentence_pieces.decode_pieces(sentence_pieces.encode_pieces(docs, SPM), SPM))
    assert all(texts[i * 3].text == (t or "") for i, t in enumerate(TEXTS))
    assert all(r.round_trip for r in sentence_pieces.round_trip(docs, SPM).collect())


def test_ogg(docs):
    def plain(data):
        c = 0
        for b in data:
            c ^= b << 24
            for _ in range(8):
                c = (c << 1 ^ 0x04C11DB7 if c >> 31 else c << 1) & 0xFFFFFFFF
        return c

    assert ogg.checksum(b"OggS\x00\xff 123") == plain(b"OggS\x00\xff 123")
    got = by_id(ogg.read_media(ogg.text_to_media(docs)))
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        whole = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = got[i * 3]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:]))
    media = bytearray(ogg.write(ogg.padded(b"abc"), 3))
    media[-1] ^= 1
    with pytest.raises(ogg.OggError):
        ogg.read(bytes(media))
    big = bytes(600) + b"z"  # a packet over two pages
    first, second = ogg.packet_lacing(601)[:2], ogg.packet_lacing(601)[2:]
    s = ogg.read(ogg.page(ogg.FIRST, -1, 5, 0, first, big[:510]) + ogg.page(ogg.LAST | ogg.CONTINUED, 601, 5, 1, second, big[510:]))
    assert s[5].packets == [big]


def test_url_filter(spark):
    rules = spark.createDataFrame([("com", "/en/", "block"), ("example.com", "/en/7", "allow"), (None, "/", "block")], url_filter.RULES_SCHEMA)
    urls = ["https://A.Example.COM/en/71?q", "http://x.com/en/9", "http://com/en/", "http://xcom/en/1", "nothing", None, "", "http://x.com?/en/", "http://x.com/en/9"]
    got = url_filter.url_verdicts(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string"), rules)
    for most in (100, 0):
        got = url_filter.url_verdicts(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string"), rules, most_broadcast=most)
        out = [(r.host, r.path, r.rule, r.verdict) for r in got.orderBy("page_id").collect()]
        assert out[0] == ("a.example.com", "/en/71", "example.com/en/7", "allow") and out[1] == ("x.com", "/en/9", "com/en/", "block") == out[8]
        assert out[2][3] == "block" and [o[3] for o in out[3:8]] == ["allow"] * 5 and out[5][:2] == ("", "") and out[7][:2] == ("x.com", "")


def test_quality_rules(docs, empty):
    got = by_id(quality_rules.cascade(docs.drop("n_words")))
    for i, t in enumerate(TEXTS):
        w, r = WORD.findall(t or ""), got[i * 3]
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        again = {k + d for k, g in enumerate(grams) if grams.count(g) > 1 for d in range(3)} if len(w) < 500 else set(range(len(w)))
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(w) < 50 or 2 * len(again) > len(w)) and not (r.base_failed and r.kept)
    assert quality_rules.cascade(empty).count() == 0
