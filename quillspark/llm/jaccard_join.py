"""N-gram Jaccard join with prefix filters under several global token orders.

Two sets with similarity t or more share a token among the first ``n - ceil(t * n) + 1`` tokens
of either set, under *every* global order of the tokens.  Order 1 is rarest first (document
frequency over the whole table, ties by hash); orders 2 and 3 put tokens of frequency 1 first and
the others by two different hashes.  Pairs come from prefixes under order 1; those that do not meet
under orders 2 and 3 too go before any token set is sent to be compared.

How it is run
1. A first pass gives each text's set size and digest.  It also names crowded tokens: those that
   many different sets of one block of texts share, with the sum of their counts.  At most
   ``MOST_CROWDED`` of them are broadcast.  Their frequency is known by that, so they skip step 2,
   and no hash range gets the entries of a token that a large share of all rows has.
2. Texts become sets of 64-bit shingle hashes; the hashes go to hash ranges as packed binary rows
   (5 bytes a token), equal sets of a task once.  A range's task finds document frequencies; tokens
   of one set only need no answer.  Equal sets count once, by the set's digest.
3. The other tokens go back to ranges of digests, where each set learns its prefixes.  A set whose
   prefix has unshared tokens only can have no partner and ends there.
4. Candidates come from shared prefix tokens.  A posting list is not expanded into pairs: its
   members are paired with two leaders, verified links are contracted into components, and only
   members of *different* components of a list are then paired with each other, if enough of
   either set comes after the shared token for it to be the first that similar sets share.  So a group
   of copies costs a number of pairs in proportion to its size, and no link between components is
   lost.
5. Where links are counted, all pairs inside each component are compared, by pairs of blocks of
   at most ``BLOCK`` sets; similar sets are always in one component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import _ranges
from quillspark.llm._cluster import cut, range_bits, release
from quillspark.llm._words import Words, blocks, mix, starts_inside, utf8, windows
from quillspark.llm.components import connected_components

U64 = np.uint64
_OWNER, _SEEDS = ["<u8", "<i4"], (U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB))

#: Sets and tokens in a block of a component, and columns of a block's matrix at a time.
BLOCK, BLOCK_TOKENS, COLUMNS = 256, 250_000, 4096
#: A token is crowded if so many different sets of a block of texts have it; the most frequent so many are broadcast.
CROWD, MOST_CROWDED = 32, 100_000


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text of each token, token hash; sorted, distinct in a text), set size and digest by text."""
    words = Words(texts, lower=True)
    h, first, count = words.hashes(), words.first, words.count
    at, doc = starts_inside(first, count, size)
    token = windows(h, size)[at] if len(at) else np.empty(0, U64)
    for k in range(1, size):  # fewer words: the whole sequence
        short = np.flatnonzero(count == k)
        if len(short):
            doc = np.concatenate([doc, short])
            token = np.concatenate([token, mix(windows(h, k)[first[:-1][short]] + U64(k))])
    order = np.argsort(token)
    doc, token = doc[order].astype(np.uint16), token[order]
    order = np.argsort(doc, kind="stable")
    doc, token = doc[order], token[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (token[1:] != token[:-1])
    doc, token = doc[new], token[new]
    n = np.bincount(doc, minlength=len(texts)).astype(np.int64)
    total = np.zeros(len(texts) + 1, U64)
    summed = np.concatenate((np.zeros(1, U64), np.cumsum(mix(token ^ U64(0x5851F42D4C957F2D)))))
    total = summed[np.cumsum(n)] - summed[np.cumsum(n) - n]
    return doc, token, n, np.where(n > 0, mix(total + n.astype(U64)), U64(0))


def _crowded(doc: np.ndarray, token: np.ndarray, digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that ``CROWD`` or more different sets have, and how many."""
    lead = np.zeros(len(digest), bool)
    lead[np.unique(digest, return_index=True)[1]] = True
    t = np.sort(token[lead[doc]])
    far = t[CROWD - 1 :]
    found = np.unique(far[far == t[: len(far)]])
    return found, np.searchsorted(t, found, "right") - np.searchsorted(t, found)


def _info(size: int):
    names = ["doc_id", "text_hash", "n_shingles", "digest", "token", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text, and rows of crowded tokens, in columns of their own."""
        release()
        for batch in batches:
            texts = [t or b"" for t in utf8(batch.column(2))]
            for i, j in blocks(texts, 2 << 20):
                doc, token, n, digest = shingle_sets(texts[i:j], size)
                none = pa.nulls(j - i, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(n), pa.array(digest.view(np.int64)), none, none], names=names)
                token, times = _crowded(doc, token, digest)
                none = pa.nulls(len(token), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(token.view(np.int64)), pa.array(times.astype(np.int64))], names=names)

    return run


def _send(size: int, bits: int, crowded: np.ndarray, frequency: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        sent: set[int] = set()
        for batch in batches:
            texts = [t or b"" for t in utf8(batch.column(0))]
            for i, j in blocks(texts, 2 << 20):
                doc, token, n, digest = shingle_sets(texts[i:j], size)
                fresh = np.zeros(j - i, bool)
                fresh[np.unique(digest, return_index=True)[1]] = True
                fresh[fresh] = [d not in sent for d in digest[fresh].tolist()]
                sent.update(digest[fresh].tolist())
                if len(sent) > 200_000:
                    sent.clear()
                keep = fresh[doc]
                doc, token = doc[keep], token[keep]
                own = [digest, n.astype("<i4")]
                if len(crowded):
                    at = np.minimum(np.searchsorted(crowded, token), len(crowded) - 1)
                    known = crowded[at] == token
                    order, ranges = _ranges.split(mix(digest)[doc[known]], bits)
                    mine, values = doc[known][order], [token[known][order], frequency[at[known]][order]]
                    yield _packed([(k, _ranges.pack(own, mine[x], [v[x] for v in values])) for k, x in ranges], True)
                    doc, token = doc[~known], token[~known]
                order, ranges = _ranges.split(token, bits)
                mine, rest = doc[order], _ranges.below(token[order], bits, 40)
                yield _packed([(k, _ranges.pack(own, mine[x], [_ranges.forty(rest[x])])) for k, x in ranges], False)

    return run


def _packed(rows: list[tuple[int, bytes]], direct: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([direct] * len(rows), pa.bool_()), pa.array([x for _, x in rows], pa.binary())], names=["part", "direct", "packed"])


def _shared(table: pa.Table, range_: int, bits: int) -> list[np.ndarray]:
    """digest, set size, token, frequency of the tokens of a range that two or more different sets have."""
    (digest, n), owner, (token,) = _ranges.unpack(table.column("packed"), _OWNER, ["b5"])
    s = np.sort(token)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    del s
    if not len(twice):
        return [digest[:0], n[:0], token[:0], np.empty(0, np.int64)]
    at = np.minimum(np.searchsorted(twice, token), len(twice) - 1)
    keep = twice[at] == token
    token, owner = token[keep], owner[keep]
    order = np.lexsort((digest[owner], token))
    token, owner = token[order], owner[order]
    d = digest[owner]
    new = np.ones(len(d), bool)
    new[1:] = (token[1:] != token[:-1]) | (d[1:] != d[:-1])
    token, owner = token[new], owner[new]
    run_start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
    df = np.diff(np.concatenate((run_start, [len(token)])))
    df = np.repeat(df, df)
    keep = df > 1
    token, owner, df = token[keep], owner[keep], df[keep]
    return [digest[owner], n[owner], token | U64(range_ << min(40, 64 - bits)), df]


def _known(table: pa.Table) -> list[np.ndarray]:
    """digest, set size, token, frequency of crowded tokens; equal sets of several tasks once."""
    (digest, n), owner, (token, df) = _ranges.unpack(table.column("packed"), _OWNER, ["<u8", "<u2"])
    order = np.lexsort((token, digest[owner]))
    token, df, owner = token[order], df[order], owner[order]
    d = digest[owner]
    new = np.ones(len(d), bool)
    new[1:] = (token[1:] != token[:-1]) | (d[1:] != d[:-1])
    return [d[new], n[owner[new]], token[new], df[new].astype(np.int64)]


def _frequent(bits: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """Tokens of two or more different sets, with their frequency, to ranges of digests."""
        release()
        direct = table.column("direct")
        parts = _shared(table.filter(pc.invert(direct)), int(key[0].as_py()), bits), _known(table.filter(direct))
        digest, n, token, df = (np.concatenate(x) for x in zip(*parts))
        place = mix(digest)
        order = np.argsort(place, kind="stable")
        digest, n, token, df, place = digest[order], n[order], token[order], df[order], place[order]
        new = np.ones(len(place), bool)
        new[1:] = place[1:] != place[:-1]
        local = np.cumsum(new) - 1
        own = [digest[new], n[new]]
        rows = []
        for k, x in _ranges.runs(place >> U64(64 - bits)):
            # an owner may hold many tokens, so local numbers are cut into rows of 60,000 owners
            for a in range(local[x][0], local[x][-1] + 1, 60_000):
                y = slice(x.start + np.searchsorted(local[x], a), x.start + np.searchsorted(local[x], a + 60_000))
                rows.append((k, _ranges.pack(own, local[y], [token[y].astype("<u8"), np.minimum(df[y], 65535).astype("<u2")])))
        return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "packed": pa.array([r[1] for r in rows], pa.binary())})

    return run


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """ceil(percent * n / 100)"""
    return -((-percent * n) // 100)


def _first(tokens: np.ndarray, take: int, seed: np.uint64) -> np.ndarray:
    """32 bits of each token of the prefix under the order that ``seed`` gives."""
    x = mix(tokens ^ seed)
    x = np.partition(x, take - 1)[:take] if take < len(x) else x
    return (x >> U64(32)).astype(np.uint32).view(np.int32)


def _prefixes(percent: int):
    def run(table: pa.Table) -> pa.Table:
        release()
        (digest, n), owner, (token, df) = _ranges.unpack(table.column("packed"), _OWNER, ["<u8", "<u2"])
        order = np.lexsort((token, df, digest[owner]))
        token, owner = token[order], owner[order]
        d = digest[owner]
        begin = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1]))) if len(d) else np.empty(0, int)
        k = np.diff(np.concatenate((begin, [len(d)])))
        size = n[owner[begin]].astype(np.int64)
        take = (size - needed(size, percent) + 1) - (size - k)
        out: dict[str, list] = {c: [] for c in _CANDIDATE}
        for i in np.flatnonzero(take > 0):
            mine, t = token[begin[i] : begin[i] + k[i]], int(take[i])
            row = int(d[begin[i]].astype(np.int64)), int(size[i]), t, mine[:t].view(np.int64), *(_first(mine, t, s) for s in _SEEDS), np.sort(mine).tobytes()
            for c, v in zip(out.values(), row):
                c.append(v)
        return pa.table({c: pa.array(v, kind) for (c, v), kind in zip(out.items(), _CANDIDATE.values())})

    return run


#: ``second`` and ``third`` are the prefixes under orders 2 and 3; ``tokens`` are ascending.
_CANDIDATE = {"digest": pa.int64(), "n": pa.int64(), "take": pa.int64(), "prefix": pa.list_(pa.int64()), "second": pa.list_(pa.int32()), "third": pa.list_(pa.int32()), "tokens": pa.binary()}
_CANDIDATE_SQL = "digest long, n long, take long, prefix array<long>, second array<int>, third array<int>, tokens binary"


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            n, m = (batch.column(c).to_pylist() for c in ("n", "n_b"))
            ok = []
            for i, sides in enumerate(zip(_ranges.values(batch.column("tokens")), _ranges.values(batch.column("tokens_b")))):
                both = len(np.intersect1d(*(np.frombuffer(x, "<u8") for x in sides), assume_unique=True))
                ok.append(100 * both >= percent * (n[i] + m[i] - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def set_table(docs: DataFrame, size: int = 5, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """doc_id, text_hash, n_shingles, digest of every text; and token, times of crowded tokens.

    Equal sets have equal digests; empty ones 0.
    """
    read = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    both = cut(read.mapInArrow(_info(size), "doc_id long, text_hash long, n_shingles long, digest long, token long, times long"))
    crowds = both.where("token IS NOT NULL").groupBy("token").agg(F.sum("times").alias("times"))
    return both.where("n_shingles IS NOT NULL").drop("token", "times"), crowds


def candidates(docs: DataFrame, items: int, crowds: DataFrame, size: int = 5, percent: int = 75, text: str = "text") -> DataFrame:
    """Sets with a shared token in their rarest-first prefix: digest, n, prefixes and shared tokens.

    ``items`` is the sum of the sets' sizes; it decides the number of hash ranges.
    """
    bits = range_bits(items)
    best = crowds.orderBy(F.col("times").desc(), "token").limit(MOST_CROWDED).toArrow()
    crowded, times = best.column("token").to_numpy().astype(np.int64).view(U64), best.column("times").to_numpy()
    order = np.argsort(crowded)
    sent = docs.select(F.col(text).alias("text")).mapInArrow(_send(size, bits, crowded[order], np.minimum(times[order], 65535).astype("<u2")), "part int, direct boolean, packed binary")
    frequent = sent.groupBy("part").applyInArrow(_frequent(bits), "part int, packed binary")
    return frequent.groupBy("part").applyInArrow(_prefixes(percent), _CANDIDATE_SQL)


def _postings(sets: DataFrame, percent: int) -> DataFrame:
    """token, digest, n, alone, pos of the posting lists of two or more sets; of equal lists only the
    first in the global order.  pos is the token's place in the set.

    Lists are equal if their size and two 64-bit digests of their members agree.  A passage that
    many texts share gives as many equal lists as it has tokens, and all of them give the same
    pairs.
    """
    first = F.expr(f"n - ceil({percent} * n / 100) + 1 - take")  # tokens that no other set has: they come first
    posts = sets.select("digest", "n", (first / F.col("n")).alias("alone"), first.alias("first"), F.posexplode("prefix").alias("i", "token"))
    posts = posts.select("digest", "n", "alone", (F.col("first") + F.col("i")).alias("pos"), "token")
    members = (F.count("*").alias("c"), F.bit_xor(F.xxhash64("digest")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "digest")).alias("y"), F.min(F.struct("digest", "pos")).alias("one"))
    lists = posts.groupBy("token").agg(*members).where("c > 1").groupBy("c", "x", "y").agg(F.min(F.struct("one.pos", "token")).alias("least")).select("least.token")
    return cut(posts.join(cut(lists), "token", "left_semi"))


def _by_leaders(posts: DataFrame, percent: int) -> DataFrame:
    """Each member of a posting list with two leaders of the list.

    One has the smallest share of tokens of its own, as an original has among its copies; the
    other differs from list to list.
    """
    one, other = (F.struct(r.alias("r"), "digest", "n") for r in (F.col("alone"), F.xxhash64("token", "digest")))
    lists = cut(posts.groupBy("token").agg(F.min(one).alias("one"), F.min(other).alias("other")))
    led = posts.join(lists, "token").select("digest", "n", F.explode(F.array(*(F.struct(f"{c}.digest", f"{c}.n") for c in ("one", "other")))).alias("q"))
    return _sized(led.where("digest <> q.digest").select("digest", "n", F.col("q.digest").alias("digest_b"), F.col("q.n").alias("n_b")), percent)


def _sized(pairs: DataFrame, percent: int) -> DataFrame:
    fits = f"100 * least(n, n_b) >= {percent} * greatest(n, n_b)"
    return pairs.where(fits).select(F.least("digest", "digest_b").alias("a"), F.greatest("digest", "digest_b").alias("b")).distinct()


def _mixed(posts: DataFrame, links: DataFrame) -> DataFrame:
    """Posting lists that still have members of two components, with each member's component."""
    roots = connected_components(links).withColumnRenamed("node", "digest")
    named = cut(posts.join(roots, "digest", "left").select("token", "digest", "n", "alone", "pos", F.coalesce("root", "digest").alias("comp")))
    mixed = named.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("token")
    return cut(named.join(cut(mixed), "token", "left_semi"))


def _across(posts: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of a posting list whose components differ, where enough tokens are left.

    At the first token that two similar sets share, each has at least
    percent / (100 + percent) * (n + n_b) tokens from there on.
    """
    right = posts.select("token", F.col("digest").alias("digest_b"), F.col("n").alias("n_b"), F.col("pos").alias("pos_b"), F.col("comp").alias("comp_b"))
    left = f"{100 + percent} * least(n - pos, n_b - pos_b) >= {percent} * (n + n_b)"
    return _sized(posts.join(right, "token").where(f"comp < comp_b AND {left}"), percent)


def _checked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The similar ones of ``pairs``.  Only those whose prefixes meet under orders 2 and 3 get their tokens."""
    side = lambda x, *columns: sets.select(F.col("digest").alias(x), *(F.col(c).alias(c if x == "a" else f"{c}_b") for c in columns))
    meet = pairs.join(side("a", "second", "third"), "a").join(side("b", "second", "third"), "b")
    meet = meet.where(F.arrays_overlap("second", "second_b") & F.arrays_overlap("third", "third_b")).select("a", "b")
    return cut(meet.join(side("a", "n", "tokens"), "a").join(side("b", "n", "tokens"), "b").mapInArrow(_verify(percent), "a long, b long"))


def _connected(docs: DataFrame, items: int, crowds: DataFrame, size: int, percent: int, text: str) -> tuple[DataFrame, DataFrame]:
    """The candidate sets, and verified links a, b between their digests that connect all that similarity connects.

    Inside a component not every similar pair is among them; ``link_counts`` counts all.
    """
    sets = cut(candidates(docs, items, crowds, size, percent, text))
    posts = _postings(sets, percent)
    done = cut(_by_leaders(posts, percent))
    links = _checked(done, sets, percent)
    rest = _across(_mixed(posts, links), percent).join(done, ["a", "b"], "left_anti")
    return sets, links.unionByName(_checked(rest, sets, percent))


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Numbers of tokens that each set of ``a`` shares with each of ``b``."""
    x, y = np.concatenate(a), np.concatenate(b)
    known = np.intersect1d(x, y)
    out = np.zeros((len(a), len(b)), np.int64)
    sides = []
    for parts, flat in ((a, x), (b, y)):
        at = np.searchsorted(known, flat)
        ok = at < len(known)
        ok[ok] = known[at[ok]] == flat[ok]
        row, col = np.repeat(np.arange(len(parts)), [len(p) for p in parts])[ok], at[ok]
        order = np.argsort(col, kind="stable")
        sides.append((row[order], col[order]))
    for c in range(0, len(known), COLUMNS):
        dense = []
        for (row, col), n in zip(sides, (len(a), len(b))):
            i, j = np.searchsorted(col, (c, c + COLUMNS))
            m = np.zeros((n, min(COLUMNS, len(known) - c)), np.float32)
            m[row[i:j], col[i:j] - c] = 1
            dense.append(m)
        out += (dense[0] @ dense[1].T).astype(np.int64)  # sums of at most COLUMNS ones are exact
    return out


def _count_links(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Links of the sets of one pair of blocks, or of several small components."""
        release()
        digest, n, weight, comp, block, i, j = (table.column(k).to_numpy() for k in ("digest", "n", "weight", "comp", "block", "i", "j"))
        tokens = [np.frombuffer(t, "<u8") for t in _ranges.values(table.column("tokens"))]
        links = np.zeros(len(n), np.int64)
        order = np.argsort(comp, kind="stable")
        for mine in np.split(order, np.flatnonzero(np.diff(comp[order])) + 1):
            alone = i[mine[0]] == j[mine[0]]
            left, right = mine[block[mine] == i[mine[0]]], mine[block[mine] == j[mine[0]]]
            if not len(left) or not len(right):
                continue
            both = _common([tokens[k] for k in left], [tokens[k] for k in right])
            similar = 100 * both >= percent * (n[left][:, None] + n[right] - both)
            if alone:
                np.fill_diagonal(similar, False)
            links[left] += similar @ weight[right]
            if not alone:
                links[right] += weight[left] @ similar
        return pa.table({"digest": pa.array(digest), "links": pa.array(links)})

    return run


def _linked(sets: DataFrame, links: DataFrame, weights: DataFrame, percent: int, block: int) -> DataFrame:
    """digest, links: how many rows of ``weights`` (digest, weight) have another similar set.

    Components of one block share tasks; of a larger one each pair of blocks is a group.
    """
    roots = connected_components(links)
    nodes = roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct().select(F.col("node").alias("digest"), F.col("root").alias("comp"))
    nodes = cut(nodes.join(sets.select("digest", "n"), "digest"))
    sized = nodes.join(nodes.groupBy("comp").agg(F.count("*").alias("members"), F.sum("n").alias("held")), "comp")
    # blocks by hash, so that no task orders a whole component
    whole = (F.col("members") <= block) & (F.col("held") <= BLOCK_TOKENS)
    parts = F.greatest(F.ceil(F.col("members") * 2 / F.lit(block)), F.ceil(F.col("held") / F.lit(BLOCK_TOKENS)))
    many = F.when(whole, F.lit(1)).otherwise(parts).cast("int")
    placed = sized.select("digest", "comp", many.alias("many"), F.pmod(F.xxhash64(F.lit(2), "digest"), many).cast("int").alias("block"))
    held = placed.join(weights, "digest").join(sets.select("digest", "n", "tokens"), "digest")
    groups = max(1, (nodes.agg(F.sum("n")).first()[0] or 0) * 4 // BLOCK_TOKENS)
    own = held.withColumn("other", F.explode(F.expr("sequence(0, many - 1)")))
    own = own.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    own = own.withColumn("place", F.when(F.col("many") > 1, F.xxhash64("comp", "i", "j")).otherwise(F.pmod(F.xxhash64("comp"), F.lit(groups))))
    rows = own.select("place", "digest", "n", "weight", "comp", "block", "i", "j", "tokens")
    # the tag keeps a small component's place apart from a pair of blocks
    counted = rows.withColumn("tag", F.struct("i", "j")).groupBy("place", "tag").applyInArrow(_count_links(percent), "digest long, links long")
    return cut(counted.groupBy("digest").agg(F.sum("links").alias("links")))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 75, text: str = "text", key: str = "doc_id", hashed: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``; with ``hashed`` text_hash too, xxhash64 of its text.

    component_id is the smallest doc_id that links reach.  Null and empty texts, and texts of
    white space, have n_shingles 0 and their own doc_id as component_id.  Rows that repeat a
    doc_id are kept, each with the component of its own text.  Rows with a null
    doc_id link nothing and have a null component_id.  An empty table gives an empty result; other
    columns are ignored.  Sets are compared by hashes of 46 bits or more within a pair and named by 64-bit digests.
    """
    return _classes(docs, size, percent, text, key, 0, hashed)


def link_counts(docs: DataFrame, size: int = 5, percent: int = 75, text: str = "text", key: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """The columns of ``near_duplicates`` and n_links: how many other rows have a similar or equal set.

    Rows with a null doc_id or without words have no links and count for none.
    """
    return _classes(docs, size, percent, text, key, block, False)


def _classes(docs: DataFrame, size: int, percent: int, text: str, key: str, block: int, hashed: bool) -> DataFrame:
    info, crowds = set_table(docs, size, text, key)
    held = info.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = cut(held.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("weight"), F.max("n_shingles").alias("n")))
    items = classes.agg(F.sum("n")).first()[0] or 0
    a, b = (classes.select(F.col("digest").alias(x), F.col("least").alias(f"id_{x}")) for x in "ab")
    sets, pairs = _connected(docs.where(F.col(key).isNotNull()), items, crowds, size, percent, text)
    links = pairs.join(a, "a").join(b, "b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    roots = connected_components(links)
    named = cut(classes.join(roots, classes.least == roots.node, "left").select("digest", "weight", F.coalesce("root", "least").alias("component_id")))
    if block:
        named = cut(named.join(_linked(sets, pairs, classes.select("digest", "weight"), percent, block), "digest", "left"))
    out = info.join(named, "digest", "left")
    own = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    more = [F.col("text_hash")] * hashed
    more += [F.when(own, F.col("weight") - 1 + F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links")] * bool(block)
    return out.select("doc_id", "n_shingles", F.when(own, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), *more)
