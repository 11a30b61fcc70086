"""Link counts of the Jaccard join against all pairs."""

import random

from quillspark.llm import jaccard_join


def _table():
    r = random.Random(11)
    vocab = [f"w{i}" for i in range(900)]
    base = [r.choice(vocab) for _ in range(80)]
    out = []
    for _ in range(300):  # one component of more than two blocks, in which only some pairs are similar
        c = list(base)
        for _ in range(r.randint(0, 3)):
            c[r.randrange(len(c))] = r.choice(vocab)
        out.append(" ".join(c))
    for _ in range(6):
        c = [r.choice(vocab) for _ in range(90)]
        out += [" ".join(c), " ".join(c), " ".join([*c[:-2], "x"]), " ".join(c[4:])]
    rows = [(i, t) for i, t in enumerate([*out, None, "", "one"])]
    return [*rows, (5, out[-1]), (None, out[0])]


def test_link_counts(spark):
    rows = _table()
    sets = []
    for _, t in rows:
        w = (t or "").split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    want = []
    for x, (i, _) in enumerate(rows):
        n = 0
        for y, (j, _) in enumerate(rows):
            both = len(sets[x] & sets[y])
            n += x != y and i is not None and j is not None and both > 0 and 100 * both >= 75 * len(sets[x] | sets[y])
        want.append((-1 if i is None else i, len(sets[x]), n))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard_join.link_counts(df, block=128)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, r.n_links) for r in got.collect()) == sorted(want)
    members = sum(r.component_id == 0 for r in got.collect())
    assert members > 128 and 0 < min(n for _, _, n in want[:300] if n) < members - 1
    key = lambda r: tuple(-1 if v is None else v for v in (r.doc_id, r.n_shingles, r.component_id))
    assert sorted(map(key, got.collect())) == sorted(map(key, jaccard_join.near_duplicates(df).collect()))
    assert jaccard_join.link_counts(df.where("false")).count() == 0
