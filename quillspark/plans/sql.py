"""DuckDB SQL with the results of the registered queries."""

from __future__ import annotations

from quillspark.functions.stopwords import DEFAULT
from quillspark.functions.text import NOT_WORD, WHITE
from quillspark.functions.vectors import hyperplanes
from quillspark.operators.lexical import WEIGHTS
from quillspark.operators.minhash import PRIME, Permutations
from quillspark.plans.queries import BANDS, BITS, DIMS, K1, SEARCH_BANDS, SEARCH_BITS

_CLEAN = f"trim(regexp_replace(coalesce(text, ''), '{WHITE}', ' ', 'g'))"
_CORPUS = f"""
p AS (SELECT doc_id, string_split({_CLEAN}, ' ') AS p FROM documents),
corpus AS (SELECT doc_id, array_to_string(p[1:8], ' ') AS title, array_to_string(p[9:], ' ') AS abstract FROM p)"""
_STOPS = ", ".join(f"'{w}'" for w in DEFAULT)


def _stem(w: str) -> str:
    plural = f"CASE WHEN {w} LIKE '%sses' OR {w} LIKE '%ies' THEN left({w}, length({w}) - 2) WHEN {w} LIKE '%s' AND {w} NOT LIKE '%ss' THEN left({w}, length({w}) - 1) ELSE {w} END"
    return plural


_STEMMED = f"""
s1 AS (SELECT *, {_stem("w")} AS a FROM bare),
s2 AS (SELECT *, CASE WHEN a LIKE '%ing' THEN CASE WHEN length(a) >= 6 AND regexp_matches(left(a, length(a) - 3), '[aeiou]') THEN left(a, length(a) - 3) ELSE a END
  WHEN a LIKE '%ed' AND length(a) >= 5 AND regexp_matches(left(a, length(a) - 2), '[aeiou]') THEN left(a, length(a) - 2) ELSE a END AS b FROM s1),
stemmed AS (SELECT *, CASE WHEN length(w) <= 3 THEN w WHEN length(b) >= 2 AND right(b, 1) = substr(b, length(b) - 1, 1) AND right(b, 1) NOT IN ('a', 'e', 'i', 'o', 'u', 'l', 's', 'f')
  THEN left(b, length(b) - 1) ELSE b END AS term FROM s2)"""
_BARE = f"regexp_replace(lower(x), '{NOT_WORD}', '', 'g')"
_TOKENS = f"""{_CORPUS},
fields AS (SELECT doc_id, 'title' AS field, title AS t FROM corpus UNION ALL SELECT doc_id, 'abstract', abstract FROM corpus),
words AS (SELECT doc_id, field, i, {_BARE} AS w FROM (SELECT doc_id, field, i, string_split(t, ' ')[i] AS x FROM fields, unnest(range(1, len(string_split(t, ' ')) + 1)) u(i))),
bare AS (SELECT * FROM words WHERE w <> '' AND w NOT IN ({_STOPS})),{_STEMMED}"""
_INDEX = f"""{_TOKENS},
postings AS (SELECT term, doc_id, field, least(count(*), 65535)::BIGINT AS tf FROM stemmed GROUP BY term, doc_id, field),
lengths AS (SELECT c.doc_id, count(s.term) FILTER (WHERE s.field = 'title')::BIGINT AS title_len, count(s.term) FILTER (WHERE s.field = 'abstract')::BIGINT AS abstract_len
  FROM corpus c LEFT JOIN stemmed s ON s.doc_id = c.doc_id GROUP BY c.doc_id),
term_stats AS (SELECT term, count(*)::BIGINT AS n FROM postings GROUP BY term)"""
_PARTS = f"""{_INDEX},
n AS (SELECT count(*) AS n_docs, avg(title_len) AS avg_title, avg(abstract_len) AS avg_abstract FROM lengths),
qt AS (SELECT doc_id AS query_id, term, count(*) AS qtf FROM stemmed WHERE field = 'title' AND doc_id % 100 = 0 GROUP BY 1, 2),
parts AS (
  SELECT q.query_id, p.doc_id, p.tf, q.qtf * ln((n_docs - t.n + 0.5) / (t.n + 0.5) + 1) * CASE p.field WHEN 'title' THEN {WEIGHTS["title"]}::DOUBLE ELSE {WEIGHTS["abstract"]}::DOUBLE END AS gain,
    CASE p.field WHEN 'title' THEN title_len / avg_title ELSE abstract_len / avg_abstract END AS share
  FROM qt q JOIN term_stats t USING (term) JOIN postings p USING (term) JOIN lengths l ON l.doc_id = p.doc_id, n
)"""


def _bm25(k1: float, b: float, k: int, name: str = "bm25") -> str:
    return f"""
{name} AS (
  SELECT query_id, rank, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
      SELECT query_id, doc_id, round(sum(gain * (tf * ({k1}::DOUBLE + 1) / (tf + {k1}::DOUBLE * (1 - {b}::DOUBLE + {b}::DOUBLE * share)))), 6) AS score FROM parts GROUP BY 1, 2
    ) WHERE score > 0
  ) WHERE rank <= {k}
)"""


_V = "v AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS x FROM embeddings)"
_COS = "list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"


def _knn(k: int, self_too: bool, name: str = "knn") -> str:
    return f"""
{name} AS (
  SELECT query_id, rank, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
      SELECT q.doc_id AS query_id, v.doc_id, round({_COS.format(a="q.x", b="v.x")}, 6) AS score FROM v q, v WHERE q.doc_id % 100 = 0 {"" if self_too else "AND q.doc_id <> v.doc_id"}
    )
  ) WHERE rank <= {k}
)"""


def _signed(bits: int) -> str:
    planes = ", ".join(f"({i}, {p.tolist()}::DOUBLE[])" for i, p in enumerate(hyperplanes(bits, DIMS)))
    return f"""{_V},
planes(i, p) AS (VALUES {planes}),
signed AS (SELECT doc_id, string_agg(CASE WHEN list_dot_product(x, p) > 0 THEN '1' ELSE '0' END, '' ORDER BY i) AS s FROM v, planes GROUP BY doc_id)"""


def _banded(n: str, b: str) -> str:
    r = f"({n} // {b})"
    return f"SELECT doc_id, {b}::INT AS b, {n}::INT AS num_bits, k AS band, array_to_string(string_split(substr(s, k * {r} + 1, {r}), ''), ',') AS bucket FROM signed, unnest(range(0, {b})) u(k)"


_BAND = f"{_signed(BITS)},\nbands AS ({_banded(str(BITS), str(BANDS))})"
_SEARCH_BAND = f"{_signed(SEARCH_BITS)},\nbands AS ({_banded(str(SEARCH_BITS), str(SEARCH_BANDS))})"
_GRID = f"""{_signed(256)},{_knn(10, False)},
bands AS ({" UNION ALL ".join(_banded(str(n), str(b)) for n in (64, 128, 256) for b in (4, 8, 16, 32))}),
cand AS (SELECT DISTINCT num_bits, b, q.doc_id AS query_id, d.doc_id FROM bands q JOIN bands d USING (num_bits, b, band, bucket) WHERE q.doc_id % 100 = 0),
counts AS (SELECT num_bits, b, query_id, count(*) AS n_candidates FROM cand GROUP BY 1, 2, 3),
scored AS (SELECT num_bits, b, query_id, c.doc_id, round(list_dot_product(q.x, d.x) / (sqrt(list_dot_product(q.x, q.x)) * sqrt(list_dot_product(d.x, d.x)) + 1e-10), 6) AS score
  FROM cand c JOIN v q ON q.doc_id = query_id JOIN v d ON d.doc_id = c.doc_id WHERE query_id <> c.doc_id),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY num_bits, b, query_id ORDER BY score DESC, doc_id) AS rk FROM scored) WHERE rk <= 10),
hits AS (SELECT num_bits, b, query_id, count(*) AS h FROM best JOIN knn USING (query_id, doc_id) GROUP BY 1, 2, 3),
truth AS (SELECT query_id, count(*) AS n FROM knn GROUP BY 1),
grid AS (SELECT c.num_bits::BIGINT AS num_bits, c.b::BIGINT AS b, (c.num_bits // c.b)::BIGINT AS r, c.query_id, n_candidates, coalesce(h, 0) / t.n AS recall
  FROM counts c JOIN truth t USING (query_id) LEFT JOIN hits USING (num_bits, b, query_id)),
summary AS (SELECT num_bits, b, r, round(avg(recall), 6) AS avg_recall, round(avg(n_candidates), 6) AS avg_candidates, round(avg(n_candidates) / (SELECT count(*) FROM embeddings) * 100, 6) AS pct_dataset FROM grid GROUP BY 1, 2, 3)"""

_RRF = f"""{_PARTS},{_bm25(1.5, 0.75, 30)},
{_V},{_knn(30, True)},
u AS (SELECT query_id, doc_id, rank, 0 AS src FROM knn UNION ALL SELECT query_id, doc_id, rank, 1 FROM bm25),
f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60.0::DOUBLE + rank)), 6) AS score, min(rank) FILTER (WHERE src = 0) AS r0, min(rank) FILTER (WHERE src = 1) AS r1 FROM u GROUP BY 1, 2),
rrf AS (SELECT query_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r0 ASC NULLS LAST, r1 ASC NULLS LAST) AS rank FROM f) WHERE rank <= 60)"""

_RECALLS = f"""{_PARTS},
{_V},{_knn(10, False)},
g AS (SELECT i / 10 AS b, j / 2 AS k1 FROM range(2, 9) a(i), range(1, 5) c(j)),
s AS (SELECT k1, b, query_id, doc_id, round(sum(gain * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * share)))), 6) AS score FROM parts, g GROUP BY 1, 2, 3, 4),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k1, b, query_id ORDER BY score DESC, doc_id) AS rk FROM s WHERE score > 0) WHERE rk <= 100),
hits AS (SELECT k1, b, query_id, count(*) AS h FROM best JOIN knn USING (query_id, doc_id) GROUP BY 1, 2, 3),
truth AS (SELECT query_id, count(*) AS n FROM knn GROUP BY 1)"""


def _signed_texts() -> str:
    """The minima of each document of eight characters or more, as a list."""
    weights, factors, shifts = Permutations().numbers()
    h = " + ".join(f"cp[i + {j}] * {w}" for j, w in enumerate(weights))
    minima = ", ".join(f"min((h * {a} + {b}) % {PRIME})" for a, b in zip(factors, shifts))
    return f"""
c AS (SELECT doc_id, {_CLEAN} AS t FROM documents),
cp AS (SELECT doc_id, list_transform(string_split(t, ''), lambda x: unicode(x)::BIGINT) AS cp FROM c WHERE length(t) >= 8),
hs AS (SELECT doc_id, ({h}) % {PRIME} AS h FROM cp, unnest(range(1, len(cp) - 6)) u(i)),
signed AS (SELECT doc_id, [{minima}] AS m FROM hs GROUP BY doc_id)"""


#: All pairs of distinct texts by their shared shingles, and what they reach.
_NEAR = """
sh AS (SELECT DISTINCT doc_id, unnest(list_distinct(list_transform(range(1, length(t) - 6), lambda i: substr(t, i, 8)))) AS g FROM (SELECT min(doc_id) AS doc_id, t FROM c WHERE length(t) >= 8 GROUP BY t)),
sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
alike AS (SELECT a, b FROM met JOIN sz p ON p.doc_id = a JOIN sz q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
links AS (SELECT a, b FROM alike UNION ALL SELECT b, a FROM alike),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM sz UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
roots AS (SELECT doc_id, min(other) AS root FROM reach GROUP BY doc_id),
named AS (SELECT c.doc_id, coalesce(r.root, c.doc_id) AS class_id FROM c LEFT JOIN (SELECT t, min(doc_id) AS first FROM c WHERE length(t) >= 8 GROUP BY t) f ON f.t = c.t LEFT JOIN roots r ON r.doc_id = f.first),
classes AS (SELECT doc_id, class_id, (count(*) OVER (PARTITION BY class_id))::BIGINT AS n_class FROM named)"""


def _embedded(table: str, key: str, name: str = "v") -> str:
    """Signed sums of the terms' weights; signs are the bits of the four 32-bit words of MD5."""
    sums = ", ".join(f"sum(CASE WHEN (h{j // 32} >> {j % 32}) & 1 = 1 THEN w ELSE -w END)::DOUBLE" for j in range(DIMS))
    words = ", ".join(f"('0x' || substr(md5(term), {1 + 8 * i}, 8))::BIGINT AS h{i}" for i in range(-(-DIMS // 32)))
    return f"""
{name}_t AS (SELECT {key}, term, length(bin(sum(tf)::BIGINT)) AS w FROM {table} GROUP BY 1, 2),
{name}_h AS (SELECT {key}, w, {words} FROM {name}_t),
{name} AS (SELECT {key}, [{sums}] AS x FROM {name}_h GROUP BY {key})"""


def oracle_sql() -> dict[str, str]:
    w = "WITH "
    return {
        "sanitize": f"SELECT doc_id, {_CLEAN} AS clean FROM documents",
        "embedding_texts": f"{w}{_CORPUS} SELECT doc_id::VARCHAR AS id, trim(title || '. ' || abstract) AS text FROM corpus",
        "tokenize": f"""{w}{_TOKENS} SELECT c.doc_id, coalesce(string_agg(term, ' ' ORDER BY i) FILTER (WHERE field = 'title'), '') AS title_tokens,
  coalesce(string_agg(term, ' ' ORDER BY i) FILTER (WHERE field = 'abstract'), '') AS abstract_tokens FROM corpus c LEFT JOIN stemmed s ON s.doc_id = c.doc_id GROUP BY c.doc_id""",
        "stem_vocab": f"""{w}x AS (SELECT unnest(string_split({_CLEAN}, ' ')) AS x FROM documents), bare AS (SELECT DISTINCT {_BARE} AS w FROM x WHERE {_BARE} <> '' AND {_BARE} NOT IN ({_STOPS})),{_STEMMED}
SELECT w AS word, term AS stem FROM stemmed""",
        "term_frequencies": f"{w}{_INDEX} SELECT * FROM postings",
        "doc_lengths": f"{w}{_INDEX} SELECT * FROM lengths",
        "term_stats": f"{w}{_INDEX} SELECT * FROM term_stats",
        "index_stats": f"{w}{_INDEX} SELECT (SELECT count(*) FROM lengths) AS n_docs, count(*) AS n_terms, sum(n)::BIGINT AS n_postings FROM term_stats",
        "bm25_top10": f"{w}{_PARTS},{_bm25(1.5, 0.75, 10)} SELECT * FROM bm25",
        "bm25_top100": f"{w}{_PARTS},{_bm25(1.2, 0.5, 100)} SELECT * FROM bm25",
        "bm25_grid_recall": f"{w}{_RECALLS} SELECT k1, b, round(avg(coalesce(h, 0) / n), 6) AS recall FROM (SELECT DISTINCT k1, b FROM best) CROSS JOIN truth LEFT JOIN hits USING (k1, b, query_id) GROUP BY 1, 2",
        "bm25_grid_pivot": f"""{w}{_RECALLS}, m AS (SELECT k1, b, round(avg(coalesce(h, 0) / n), 6) AS recall FROM (SELECT DISTINCT k1, b FROM best) CROSS JOIN truth LEFT JOIN hits USING (k1, b, query_id) GROUP BY 1, 2)
SELECT b, {', '.join(f'max(recall) FILTER (WHERE k1 = {k}) AS k1_{str(k).replace(chr(46), chr(95))}' for k in K1)} FROM m GROUP BY b""",
        "titles": f"{w}{_CORPUS} SELECT doc_id, title FROM corpus",
        "truth_query_texts": f"{w}{_CORPUS}, t AS (SELECT DISTINCT vec_id FROM embeddings WHERE vec_id % 100 = 0) SELECT doc_id AS query_id, abstract AS text FROM corpus SEMI JOIN t ON vec_id = doc_id",
        "prefix_sample": f"{w}{_CORPUS} SELECT doc_id AS id, title FROM corpus ORDER BY doc_id LIMIT 100",
        "exact_knn_top10": f"{w}{_V},{_knn(10, False)} SELECT * FROM knn",
        "cosine_pairs": f"{w}{_V} SELECT a.doc_id, round({_COS.format(a='a.x', b='b.x')}, 6) AS cosine FROM v a JOIN v b ON b.doc_id = a.doc_id + 1",
        "rrf_fusion": f"{w}{_RRF} SELECT * FROM rrf",
        "hybrid_search": f"{w}{_RRF} SELECT query_id, rank, r.doc_id, score, coalesce(title, 'Title not found.') AS title FROM rrf r LEFT JOIN corpus c ON c.doc_id = r.doc_id",
        "report_lines": f"{w}{_CORPUS},{_V},{_knn(10, False)} SELECT query_id, rank, printf('%d. [Score: %.4f] %s (ID: %s)', rank, score, coalesce(title, 'Title not found.'), k.doc_id::VARCHAR) AS line FROM knn k LEFT JOIN corpus c ON c.doc_id = k.doc_id",
        "lsh_signatures": f"{w}{_signed(BITS)} SELECT doc_id, s AS signature FROM signed",
        "lsh_bands": f"{w}{_BAND} SELECT doc_id, band::INT AS band, bucket FROM bands",
        "lsh_candidate_groups": f"""{w}{_BAND}, g AS (SELECT band, bucket, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS members FROM bands GROUP BY band, bucket HAVING count(*) > 1),
f AS (SELECT members, min({{'band': band, 'bucket': bucket}}) AS first FROM g GROUP BY members)
SELECT b.band::INT AS band, b.bucket, doc_id FROM bands b JOIN f ON f.first.band = b.band AND f.first.bucket = b.bucket""",
        "lsh_search": f"""{w}{_SEARCH_BAND}, c AS (SELECT DISTINCT q.doc_id AS query_id, d.doc_id FROM bands q JOIN bands d USING (band, bucket) WHERE q.doc_id % 100 = 0),
s AS (SELECT query_id, c.doc_id, round({_COS.format(a="q.x", b="d.x")}, 6) AS score FROM c JOIN v q ON q.doc_id = query_id JOIN v d ON d.doc_id = c.doc_id)
SELECT query_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""",
        "lsh_grid": f"{w}{_GRID} SELECT * FROM summary",
        "recall_pivot": f"{w}{_GRID} SELECT num_bits, {', '.join(f'round(avg(recall) FILTER (WHERE b = {b}), 6) AS b{b}' for b in (4, 8, 16, 32))} FROM grid GROUP BY num_bits",
        "pareto_frontier": f"""{w}{_GRID} SELECT num_bits, b, r, avg_recall, avg_candidates, pct_dataset FROM (
  SELECT *, max(avg_recall) OVER (ORDER BY avg_candidates, avg_recall DESC, num_bits, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM summary) WHERE avg_recall > coalesce(before, -1)""",
        "lsh_s_curve": f"""{w}{_BAND}, p AS (SELECT a.doc_id AS a, b.doc_id AS b, round({_COS.format(a='a.x', b='b.x')}, 6) AS c FROM v a JOIN v b ON b.doc_id = a.doc_id + 1),
met AS (SELECT DISTINCT p.a, p.b FROM p JOIN bands x ON x.doc_id = p.a JOIN bands y ON y.doc_id = p.b AND y.band = x.band AND y.bucket = x.bucket),
k AS (SELECT p.*, m.a IS NOT NULL AS met, 1 - pow(1 - pow(greatest(least(c, 1), 0), {BITS // BANDS}), {BANDS}) AS x, 1 - pow(1 - pow(1 - acos(greatest(least(c, 1), -1)) / pi(), {BITS // BANDS}), {BANDS}) AS y FROM p LEFT JOIN met m ON m.a = p.a AND m.b = p.b WHERE NOT isnan(c))
SELECT round(c, 1) AS s, count(*) AS n, round(avg(x), 6) AS p_linear, round(avg(y), 6) AS p_angle, round(avg(met::INT), 6) AS observed FROM k GROUP BY 1""",
        "candidate_histogram": f"""{w}{_GRID}, e AS (SELECT min(n_candidates) AS lo, max(n_candidates) AS hi FROM grid)
SELECT CASE WHEN hi = lo THEN 1 ELSE least(floor((n_candidates - lo) * 30 / (hi - lo)) + 1, 30) END::BIGINT AS bin, count(*) AS n FROM grid, e GROUP BY 1""",
        "minhash_signatures": f"{w}{_signed_texts()} SELECT doc_id, array_to_string(m, ',') AS signature FROM signed",
        "near_duplicate_classes": f"WITH RECURSIVE c AS (SELECT doc_id, {_CLEAN} AS t FROM documents),{_NEAR} SELECT * FROM classes",
        "minhash_agreement": f"""WITH RECURSIVE {_signed_texts()},{_NEAR},
pairs AS (SELECT doc_id AS a, class_id AS b FROM classes WHERE doc_id <> class_id),
own AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, length(t) - 6), lambda i: substr(t, i, 8))) AS g FROM c WHERE doc_id IN (SELECT a FROM pairs UNION SELECT b FROM pairs)),
own_n AS (SELECT doc_id, count(*) AS n FROM own GROUP BY doc_id),
shared AS (SELECT a, b, count(*) AS k FROM pairs JOIN own x ON x.doc_id = a JOIN own y ON y.doc_id = b AND y.g = x.g GROUP BY a, b)
SELECT a, b, round(k / (p.n + q.n - k), 6) AS jaccard, round(len(list_filter(range(1, 101), lambda i: u.m[i] = v.m[i])) / 100, 6) AS agreement
FROM shared JOIN own_n p ON p.doc_id = a JOIN own_n q ON q.doc_id = b JOIN signed u ON u.doc_id = a JOIN signed v ON v.doc_id = b""",
        "vocabulary": f"{w}{_INDEX} SELECT term, (row_number() OVER (ORDER BY term))::BIGINT - 1 AS id FROM term_stats",
        "one_hot_rows": f"""{w}{_INDEX}, ids AS (SELECT term, (row_number() OVER (ORDER BY term))::BIGINT - 1 AS id FROM term_stats)
SELECT l.doc_id, (SELECT count(*) FROM ids) AS size, count(id)::BIGINT AS n, coalesce(string_agg(id::VARCHAR, ',' ORDER BY id), '') AS indices
FROM lengths l LEFT JOIN (SELECT DISTINCT doc_id, id FROM postings JOIN ids USING (term)) p ON p.doc_id = l.doc_id GROUP BY l.doc_id""",
        "text_embeddings": f"{w}{_INDEX},{_embedded('postings', 'doc_id')} SELECT doc_id, array_to_string(list_transform(x, lambda z: z::BIGINT), ',') AS vector FROM v",
        "semantic_text_exact": f"""{w}{_INDEX},{_embedded('postings', 'doc_id')},
asked AS (SELECT doc_id, term, 'title' AS field, count(*) AS tf FROM stemmed WHERE field = 'title' AND doc_id % 100 = 0 GROUP BY 1, 2),{_embedded('asked', 'doc_id', 'q')},
s AS (SELECT q.doc_id AS query_id, v.doc_id, round({_COS.format(a="q.x", b="v.x")}, 6) AS score FROM q, v)
SELECT query_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE NOT isnan(score)) WHERE rank <= 10""",
        "shingle_counts": f"WITH c AS (SELECT doc_id, {_CLEAN} AS t FROM documents) SELECT doc_id, count(DISTINCT substr(t, i, 8)) FILTER (WHERE i > 0)::BIGINT AS n_shingles FROM c, unnest(CASE WHEN length(t) >= 8 THEN range(1, length(t) - 6) ELSE [0] END) u(i) GROUP BY doc_id",
    }
