"""The queries opN_<name> and pipeline, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontamination, fill_in_middle, jaccard_join, license_scan, ogg, packing, quality_grade, quality_rules, sentence_pieces, substring_dedup, toxicity, url_filter, vector_codes
from quillspark.llm._terms import held_out

#: (host, path, action)
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "block"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its class and its number of links."""
    return jaccard_join.link_counts(_table(spark, sf_dir, "documents"))


def op3_quality_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades of the labels: 0 low quality, 1 good but toxic, 2 good.  Kept: grade 1 or more is likelier."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return quality_grade.grade_quality(docs, quality_grade.train(docs, labels, F.col("quality") * (F.lit(2) - F.col("toxic"))))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents")).drop("spans")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.read_media(ogg.text_to_media(_table(spark, sf_dir, "documents")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scores = toxicity.score_toxicity(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))
    return scores.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, url_filter.RULES_SCHEMA)
    return url_filter.url_verdicts(_table(spark, sf_dir, "pages"), rules)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.cascade(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle.restore(fill_in_middle.fill_in_middle(_table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("item_ids", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), items.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vector")
    coded, books = vector_codes.compress(vectors)
    out = vector_codes.with_label_errors(coded)
    return out.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.codebooks_digest(books)).alias("codebooks_sha256"))


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op4 that SQL can express."""
    return op4_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6 that SQL can express."""
    return op6_sentence_pieces(spark, sf_dir).select("doc_id", "decoded_sha256", "round_trip")


def ogg_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op7 that SQL can express."""
    return op7_ogg_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "error")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_best_fit_packing, op2_jaccard_join, op3_quality_grade, op4_license_scan, op5_substring_dedup]
    own += [op6_sentence_pieces, op7_ogg_media, op8_toxicity, op9_url_filter, op10_quality_rules, op11_fill_in_middle, op12_decontamination, op13_vector_codes, pipeline, license_base, piece_round_trip, ogg_payload]
    return {f.__name__: f for f in own}


_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP2 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 3, 2))) t(i) WHERE len(ws) > 0
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * p.c >= 75 * (na.n + nb.n - p.c)
),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.least, d.doc_id)::BIGINT AS component_id, coalesce(k.n_links, 0)::BIGINT AS n_links
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, count(*) AS n_links FROM links GROUP BY a) k ON k.a = d.doc_id LEFT JOIN (SELECT doc_id, min(other) AS least FROM reach GROUP BY doc_id) c ON c.doc_id = d.doc_id
"""

_OP5 = f"""
WITH w AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM w, unnest(range(1, greatest(len(ws) - 48, 1))) t(i)),
m AS (SELECT h, min(doc_id) AS d FROM p GROUP BY h),
gone AS (SELECT DISTINCT p.doc_id, p.i + k AS pos FROM p JOIN m ON m.h = p.h, unnest(range(0, 50)) u(k) WHERE p.doc_id > m.d),
each AS (SELECT w.doc_id, i AS pos, ws[i] AS word FROM w, unnest(range(1, len(ws) + 1)) t(i)),
marked AS (SELECT e.doc_id, e.pos, e.word, g.pos IS NOT NULL AS out FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.pos = e.pos),
sums AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE out) AS r, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT out) AS kept FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(r, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN sums ON sums.doc_id = d.doc_id
"""

_OP9 = """
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(coalesce(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2), '') AS path FROM r
),
rules(rh, rp, action) AS (VALUES {rules}),
v AS (
  SELECT *, (SELECT rh || rp || ' ' || action FROM rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) ORDER BY length(rh || rp) DESC LIMIT 1) AS hit FROM p
)
SELECT page_id, host, path, split_part(hit, ' ', 1) AS rule, CASE WHEN hit IS NULL THEN 'allow' ELSE split_part(hit, ' ', 2) END AS verdict FROM v
""".format(rules=", ".join(str(r) for r in URL_RULES))

_OP10 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, {_WORDS.format(text="t")} AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 1, 1))) t(i)),
again AS (SELECT doc_id, g FROM g GROUP BY doc_id, g HAVING count(*) > 1),
places AS (SELECT DISTINCT g.doc_id, g.i + k AS pos FROM g JOIN again a ON a.doc_id = g.doc_id AND a.g = g.g, unnest(range(0, 3)) u(k)),
rep AS (SELECT doc_id, count(*) AS n FROM places GROUP BY doc_id),
c AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id
),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 20 * n_words OR (n_lines > 3 AND 100 * n_dup_lines > 50 * n_lines)
       OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM b
"""


_LICENSE = f"""
WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS ws FROM documents),
p AS (
  SELECT doc_id, i - 1 AS pos, CASE WHEN ws[i] = 'mit' AND ws[i + 1] = 'license' THEN 'mit' WHEN ws[i] = 'apache' AND ws[i + 1] = 'license' THEN 'apache'
    WHEN ws[i] = 'general' AND ws[i + 1] = 'public' AND ws[i + 2] = 'license' THEN 'gpl' END AS label FROM w, unnest(range(1, len(ws) + 1)) t(i)
),
b AS (SELECT doc_id, count(*) AS n, min(pos) AS a, max(pos) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM p WHERE label IS NOT NULL GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a AS first_word, z AS last_word, coalesce(labels, '') AS base_labels
FROM w LEFT JOIN b ON b.doc_id = w.doc_id
"""

_OGG = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents),
n AS (SELECT *, octet_length(t)::BIGINT AS n FROM d),
p AS (SELECT *, CASE WHEN n = 0 THEN 576 ELSE (576 - n % 576) % 576 END AS more FROM n)
SELECT doc_id, n AS n_bytes, n + more AS payload_bytes, sha256(t || repeat('\\xFF'::BLOB, more)) AS payload_sha256, NULL::VARCHAR AS error FROM p
"""

_PIECES = "SELECT doc_id, sha256(replace(coalesce(text, ''), chr(9601), ' ')) AS decoded_sha256, true AS round_trip FROM documents"


_OP11 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id::VARCHAR) AS h FROM documents),
u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS us,
    ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d
),
c AS (SELECT *, len(us) AS n, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS a, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS b FROM u),
p AS (
  SELECT doc_id, t, n, array_to_string(us[1:a], '') AS pre, array_to_string(us[a + 1:b], '') AS mid, array_to_string(us[b + 1:], '') AS suf,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM c
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""

_OP12 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS m, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS g FROM b, unnest(range(1, greatest(len(ws) - 8, 2))) t(i) WHERE len(ws) > 0),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS g FROM d, ms, unnest(range(1, len(ws) - m + 2)) t(i)),
hit AS (SELECT DISTINCT doc_id, i, m, item_id FROM dw JOIN bw USING (m, g)),
places AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM hit, unnest(range(0, m)) u(k) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(p.n, 0)::BIGINT AS n_hit, coalesce(x.n, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(p.n, 0) > 0 AS contaminated
FROM d LEFT JOIN places p ON p.doc_id = d.doc_id LEFT JOIN named x ON x.doc_id = d.doc_id
"""


def _codes_sql(rounds: int = 6) -> str:
    """Each round as tables: the codebooks, every part's nearest entry, the entries' new components."""
    out = """
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
parts AS MATERIALIZED (SELECT vec_id, p, v[p * (len(v) // 8) + 1:(p + 1) * (len(v) // 8)] AS x FROM kept, unnest(range(8)) t(p)),
book0 AS MATERIALIZED (SELECT p, (row_number() OVER (PARTITION BY p ORDER BY vec_id))::BIGINT - 1 AS e, x AS c FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 16))"""
    for r in range(rounds + 1):
        out += f""",
near{r} AS MATERIALIZED (
  SELECT vec_id, p, x, e, d FROM (
    SELECT vec_id, p, x, e, d, row_number() OVER (PARTITION BY vec_id, p ORDER BY d, e) AS k FROM (
      SELECT vec_id, a.p, x, e, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT AS d FROM parts a JOIN book{r} b ON a.p = b.p
    )
  ) WHERE k = 1
)"""
        if r < rounds:
            out += f""",
mean{r} AS (SELECT p, e, list(m ORDER BY i) AS c FROM (SELECT p, e, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS m FROM near{r}, unnest(range(1, len(x) + 1)) t(i) GROUP BY p, e, i) GROUP BY p, e),
book{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN mean{r} m ON m.p = b.p AND m.e = b.e)"""
    return (
        out
        + f""",
coded AS (SELECT vec_id, string_agg(lpad(printf('%x', e), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY vec_id),
labelled AS (SELECT k.vec_id, label, code, error FROM kept k JOIN coded USING (vec_id))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256 FROM labelled
"""
    )


def oracle_sql() -> dict[str, str]:
    base = {"license_base": _LICENSE, "piece_round_trip": _PIECES, "ogg_payload": _OGG}
    return base | {"op2_jaccard_join": _OP2, "op5_substring_dedup": _OP5, "op9_url_filter": _OP9, "op10_quality_rules": _OP10, "op11_fill_in_middle": _OP11, "op12_decontamination": _OP12, "op13_vector_codes": _codes_sql()}
