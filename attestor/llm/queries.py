"""The queries ``opN_<name>`` and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, collocations, decontaminate, langid, lexical, line_dedup, lm_score, simhash, token_counts, token_files, url_filter, warc
from .byte_bpe import vocabulary_path

#: Fixed values: the URL rules (host, path, verdict).
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.evaluate(_table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


OP2_SQL = r"""
WITH lowered AS (SELECT doc_id, row_number() OVER () AS n, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM documents),
items AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM benchmark),
sized AS (SELECT item_id, words, least(13, len(words)) AS size FROM items WHERE len(words) > 0),
windows AS (SELECT DISTINCT item_id, size, array_to_string(words[p : p + size - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(words) - size + 2)) AS p FROM sized)),
sizes AS (SELECT DISTINCT size FROM windows),
grams AS (SELECT n, size, p, array_to_string(words[p : p + size - 1], ' ') AS gram FROM (SELECT l.n, l.words, s.size, unnest(range(1, len(l.words) - s.size + 2)) AS p FROM lowered l, sizes s WHERE len(l.words) >= s.size)),
found AS (SELECT g.n, g.p, g.size, w.item_id FROM grams g JOIN windows w ON g.size = w.size AND g.gram = w.gram),
hits AS (SELECT n, count(DISTINCT q) AS n_hit FROM (SELECT n, unnest(range(p, p + size)) AS q FROM (SELECT DISTINCT n, p, size FROM found)) GROUP BY n),
named AS (SELECT n, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM found GROUP BY n)
SELECT l.doc_id, CAST(len(l.words) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(d.n_items, 0) AS n_items, sha256(coalesce(d.names, '')) AS items_sha256,
  coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(l.words) AS contaminated
FROM lowered l LEFT JOIN hits h USING (n) LEFT JOIN named d USING (n)
"""


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_kept")


OP3_SQL = r"""
WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
ls AS (SELECT doc_id, unnest(ls) AS s, unnest(range(len(ls))) AS k FROM split),
full_lines AS (SELECT * FROM ls WHERE regexp_matches(s, '[^ 	

]')),
firsts AS (SELECT s, min((doc_id, k)) AS place FROM full_lines GROUP BY s),
longs AS (SELECT s, place, length(s) AS n, substr(s, 1, 8) AS head, substr(s, length(s) - 7) AS tail FROM firsts WHERE length(s) >= 16),
near AS (
  SELECT a.s FROM longs a JOIN longs b ON a.head = b.head AND b.place < a.place AND abs(a.n - b.n) <= 1 WHERE levenshtein(a.s, b.s) <= 1
  UNION SELECT a.s FROM longs a JOIN longs b ON a.tail = b.tail AND b.place < a.place AND abs(a.n - b.n) <= 1 WHERE levenshtein(a.s, b.s) <= 1),
stays AS (SELECT place FROM firsts WHERE s NOT IN (SELECT s FROM near)),
kept AS (SELECT doc_id, k, s FROM ls WHERE (doc_id, k) IN (SELECT place FROM stays) OR NOT regexp_matches(s, '[^ 	

]')),
joined AS (SELECT doc_id, string_agg(s, chr(10) ORDER BY k) AS text, count(*) AS n_kept FROM kept GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(j.text, '') END AS text, CAST(coalesce(len(d.ls), 0) AS INTEGER) AS n_lines, CAST(coalesce(j.n_kept, 0) AS INTEGER) AS n_kept
FROM split d LEFT JOIN joined j USING (doc_id)
"""


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), vocabulary_path())


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), vocabulary_path())


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), url_filter.rule_table(spark, URL_RULES))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_read(_table(spark, sf_dir, "documents"), vocabulary_path())


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_table(spark, sf_dir, "documents"), langid.held_out("doc_id", 7, 2))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.write_and_read(_table(spark, sf_dir, "pages"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_table(spark, sf_dir, "documents"))


OP8_SQL = """
WITH rules(host, path, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
parts AS (SELECT page_id, url, CASE WHEN url IS NOT NULL AND strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT page_id, url, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM parts),
urls AS (SELECT page_id, url, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts),
keyed AS (SELECT *, row_number() OVER () AS n FROM urls),
fits AS (SELECT k.n, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY k.n ORDER BY length(r.host) + length(r.path) DESC, length(r.host) DESC) AS place
  FROM keyed k JOIN rules r ON (k.host = r.host OR ends_with(k.host, '.' || r.host)) AND starts_with(k.path, r.path))
SELECT k.page_id, k.host, k.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM keyed k LEFT JOIN fits f ON f.n = k.n AND f.place = 1
"""

OP11_SQL = """
WITH facts AS (SELECT page_id, url, encode(coalesce(html, '')) AS payload FROM pages),
sized AS (SELECT page_id, url, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM facts),
placed AS (SELECT *, row_number() OVER w AS place, first_value(page_id) OVER w AS first_id FROM sized WINDOW w AS (PARTITION BY payload_digest ORDER BY page_id NULLS LAST, url NULLS LAST))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 100 AND place > 1 THEN first_id END AS refers_to FROM placed
"""

OP12_SQL = r"""
WITH lowered AS (SELECT doc_id, row_number() OVER () AS d, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM documents),
docs AS (SELECT doc_id, d, words, CAST(len(words) AS BIGINT) AS n FROM lowered WHERE len(words) > 0),
sums AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM docs),
items AS (SELECT item_id, row_number() OVER () AS i, list_distinct(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')) AS words FROM benchmark),
asked AS (SELECT i, item_id, unnest(words) AS term FROM items),
tf AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(words) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM df, sums),
adds AS (SELECT tf.d, tf.term, w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (10 + (90 * x.n * s.docs) // s.words))) AS add FROM tf JOIN docs x USING (d) JOIN weights w USING (term), sums s),
scores AS (SELECT i, item_id, d, CAST(sum(add) AS BIGINT) AS score FROM asked JOIN adds USING (term) GROUP BY ALL),
ranked AS (SELECT s.i, s.item_id, x.doc_id, s.score, row_number() OVER (PARTITION BY s.i ORDER BY s.score DESC, x.doc_id NULLS LAST) AS rank FROM scores s JOIN docs x USING (d) WHERE s.score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

OP13_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
split AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS ws FROM pieces),
grams AS (SELECT lang, size, array_to_string(ws[p : p + size - 1], ' ') AS phrase FROM (SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS p FROM split, (SELECT unnest([1, 2, 3, 4]) AS size) WHERE len(ws) >= size)),
counted AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
sizes AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM split GROUP BY lang),
candidates AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM counted WHERE size >= 2),
cuts AS (SELECT lang, size, phrase, a, k, array_to_string(ws[1 : k], ' ') AS head, array_to_string(ws[k + 1 : size], ' ') AS tail FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates)),
scored AS (SELECT c.*, x.f AS l, y.f AS r, (CAST(2000000 AS HUGEINT) * c.a) // (x.f + y.f) AS score FROM cuts c JOIN counted x ON c.lang = x.lang AND c.head = x.phrase JOIN counted y ON c.lang = y.lang AND c.tail = y.phrase),
lowest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM scored) WHERE place = 1),
inner_ AS (SELECT lang, array_to_string(ws[p : p + m - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT *, unnest(range(1, size - m + 2)) AS p FROM candidates, (SELECT unnest([2, 3]) AS m) WHERE m < size) GROUP BY ALL),
kept AS (SELECT s.* FROM lowest s LEFT JOIN inner_ i ON s.lang = i.lang AND s.phrase = i.phrase WHERE i.longer IS NULL OR 100 * i.longer < 80 * s.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, z.n, CAST(r.score AS BIGINT) AS score FROM ranked r JOIN sizes z USING (lang) WHERE r.rank <= 2000
"""

QUERIES = {
    "op1_langid": op1_langid,
    "op2_decontaminate": op2_decontaminate,
    "op3_line_dedup": op3_line_dedup,
    "op4_bpe_round_trip": op4_bpe_round_trip,
    "op5_simhash": op5_simhash,
    "op6_ann": op6_ann,
    "op7_token_counts": op7_token_counts,
    "op8_url_filter": op8_url_filter,
    "op9_token_files": op9_token_files,
    "op10_lm_score": op10_lm_score,
    "op11_warc": op11_warc,
    "op12_lexical_search": op12_lexical_search,
    "op13_collocations": op13_collocations,
}

ORACLES = {
    "op2_decontaminate": OP2_SQL,
    "op3_line_dedup": OP3_SQL,
    "op8_url_filter": OP8_SQL,
    "op11_warc": OP11_SQL,
    "op12_lexical_search": OP12_SQL,
    "op13_collocations": OP13_SQL,
}
