"""The registered queries of the corpus operators, with production parameters, and their oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, disclosure, exact_dedup, fill_middle, html_extract, language_id, lm_score, mixing, ngram_join, periodic_runs, substring_dedup, url_filter, warc
from .shared import words

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The path rules of op1 (fixed values).
RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
#: op1 lists every canonical URL seen on a host whose first label (after ``www.``) is one of these.
LISTED_LABELS = ("spam-farm", "cheap-pills")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    host, path = url_filter.url_host(F.col("url")), url_filter.url_path(F.col("url"))
    on_list = F.regexp_extract(host, r"^(?:www\.)?([^.]*)", 1).isin(*LISTED_LABELS)
    listed = pages.filter(on_list).select(url_filter.canonical(host, path).alias("key"))
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    return url_filter.judge(pages, listed, rules)


ORACLE_SQL["op1_url_filter"] = r"""
WITH p AS (SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM pages),
c AS (SELECT *, concat(regexp_replace(host, '^www\.', ''), regexp_replace(path, '(\.html|/+)$', '')) AS canonical_url FROM p),
l AS (SELECT DISTINCT canonical_url FROM c WHERE regexp_extract(host, '^(?:www\.)?([^.]*)', 1) IN ('spam-farm', 'cheap-pills')),
r(rule, rh, rp, rv) AS (VALUES ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'), ('net/de/', 'net', '/de/', 'block'),
                               ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')),
m AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(rv, length(rule)) AS rv FROM c JOIN r
      ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT c.page_id, host, path, rule, coalesce(rv, CASE WHEN host <> '' AND l.canonical_url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       c.canonical_url, (host <> '' AND l.canonical_url IS NOT NULL) AS listed
FROM c LEFT JOIN m USING (page_id) LEFT JOIN l ON l.canonical_url = c.canonical_url
"""


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"), keep="largest")


ORACLE_SQL["op2_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.withColumn("items", F.array_join("items", ","))


ORACLE_SQL["op4_decontaminate"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x09-\x0D\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+') AS t FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x09-\x0D\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+') AS t FROM benchmark),
m AS (SELECT item_id, t, least(len(t), 5) AS k FROM b WHERE len(t) > 0),
g AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(t, i, i + k - 1), ' ') AS s FROM (SELECT *, unnest(range(1, len(t) - k + 2)) AS i FROM m)),
n AS (SELECT item_id, count(*) AS n FROM g GROUP BY item_id),
h AS (SELECT DISTINCT doc_id, k, array_to_string(list_slice(t, i, i + k - 1), ' ') AS s
      FROM (SELECT doc_id, t, k, unnest(range(1, len(t) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM m) WHERE len(t) >= k)),
c AS (SELECT doc_id, item_id, count(*) AS c FROM h JOIN g ON h.k = g.k AND h.s = g.s GROUP BY ALL),
f AS (SELECT doc_id, c.item_id, c / n AS share FROM c JOIN n ON n.item_id = c.item_id WHERE 5 * c >= 4 * n)
SELECT d.doc_id, count(item_id) > 0 AS contaminated, count(item_id) AS n_items, coalesce(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id), '') AS items,
       coalesce(max(share), 0.0) AS containment FROM d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id
"""


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archived(_table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL["op5_warc"] = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to FROM f
"""


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(_table(spark, sf_dir, "documents"), n=4, num=85, den=100)


ORACLE_SQL["op6_ngram_join"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(t) < 4 THEN array_to_string(t, ' ') ELSE concat_ws(' ', t[i], t[i + 1], t[i + 2], t[i + 3]) END AS g
      FROM (SELECT doc_id, t, unnest(range(1, greatest(len(t) - 3, 1) + 1)) AS i FROM w WHERE len(t) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(v, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v AND r.c < e.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(c) FROM r WHERE v = d.doc_id) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
"""


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.fit(docs.filter(~language_id.held_out()))
    found = language_id.identify(docs, model)
    return found.withColumn("held_out", language_id.held_out()).select("doc_id", "held_out", "lang_pred", "score")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"))


ORACLE_SQL["op10_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS t FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(list_slice(t, i, i + 49), ' ')) AS h FROM (SELECT doc_id, t, unnest(range(1, len(t) - 48)) AS i FROM w WHERE len(t) >= 50)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS m FROM g) WHERE doc_id > m),
x AS (SELECT DISTINCT doc_id, i + k AS p FROM r, range(0, 50) AS o(k)),
a AS (SELECT w.doc_id, u.p, t[u.p] AS word FROM w, unnest(range(1, len(t) + 1)) AS u(p)),
k AS (SELECT a.doc_id, count(x.p) AS n_removed, string_agg(a.word, ' ' ORDER BY a.p) FILTER (WHERE x.p IS NULL) AS kept FROM a LEFT JOIN x ON x.doc_id = a.doc_id AND x.p = a.p GROUP BY a.doc_id)
SELECT w.doc_id, len(w.t) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""


def op11_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = disclosure.disclosures(_table(spark, sf_dir, "documents"))
    counts = [F.size(kind).cast("long").alias(f"n_{kind}") for kind in disclosure.KINDS]
    return found.select("doc_id", *counts, F.sha2(disclosure.listed(*disclosure.KINDS), 256).alias("base_sha256"), disclosure.listed(*disclosure.KINDS, "generalise", "remove").alias("spans"))


ORACLE_SQL["op11_disclosure"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
k(kind, o, pat) AS (VALUES ('email', 1, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), ('ip', 2, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)'),
                           ('card', 3, '[0-9](?:[\x20-]?[0-9])+'), ('phone', 4, '\+[0-9][\x20().0-9-]+[0-9]')),
m AS (SELECT r, kind, o, regexp_extract_all(text, pat) AS f, regexp_split_to_array(text, pat) AS g FROM d, k),
u AS (SELECT r, kind, o, unnest(range(1, len(f) + 1)) AS i, f, g FROM m WHERE len(f) > 0),
a AS (SELECT r, kind, o, i, f[i] AS v, g[i] AS before, g[i + 1] AS after, sum(length(f[i]) + length(g[i])) OVER (PARTITION BY r, kind ORDER BY i) AS e FROM u),
c AS (SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS dg FROM a),
b AS (SELECT r, kind, o, CAST(e - length(v) AS BIGINT) AS s, CAST(e AS BIGINT) AS e, before, after,
             CASE kind WHEN 'email' THEN translate(v, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') WHEN 'ip' THEN v ELSE dg END AS value FROM c
      WHERE CASE kind WHEN 'ip' THEN regexp_matches(v, '^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$')
                      WHEN 'phone' THEN length(dg) BETWEEN 9 AND 15
                      WHEN 'card' THEN length(dg) BETWEEN 13 AND 19 AND list_sum([CASE WHEN x % 2 = 1 THEN CAST('0246813579'[CAST(dg[length(dg) - x] AS INT) + 1] AS INT) ELSE CAST(dg[length(dg) - x] AS INT) END
                                                                                  for x in range(0, length(dg))]) % 10 = 0
                      ELSE true END),
w0 AS (SELECT r, kind, value, unnest([array_to_string(list_slice(regexp_split_to_array(before, '[\x20\x09-\x0D]+'), -9, -1), ' '), array_to_string(list_slice(regexp_split_to_array(after, '[\x20\x09-\x0D]+'), 1, 9), ' ')]) AS t,
              unnest([1, 2]) AS side, row_number() OVER () AS w FROM b),
w1 AS (SELECT r, kind, value, w, side, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+', ' ', 'g'), '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)', ' ', 'g'),
                                     '[0-9](?:[\x20-]?[0-9])+', ' ', 'g'), '\+[0-9][\x20().0-9-]+[0-9]', ' ', 'g') AS t FROM w0),
w2 AS (SELECT r, kind, value, w, max(t) FILTER (WHERE side = 1) || chr(1) || max(t) FILTER (WHERE side = 2) AS win FROM w1 GROUP BY ALL),
p0 AS (SELECT r, kind, value, win, unnest(regexp_extract_all(win, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM w2),
p AS (SELECT kind, value, term, count(DISTINCT r) AS n_pair FROM p0 WHERE length(term) >= 3 AND regexp_matches(term, '[^0-9]') GROUP BY ALL HAVING count(DISTINCT win) >= 3),
ne AS (SELECT kind, value, count(DISTINCT r) AS n_entity FROM b GROUP BY ALL),
t0 AS (SELECT r, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS f, regexp_split_to_array(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS g FROM d),
t1 AS (SELECT r, unnest(range(1, len(f) + 1)) AS i, f, g FROM t0 WHERE len(f) > 0),
t AS (SELECT r, f[i] AS term, sum(length(f[i]) + length(g[i])) OVER (PARTITION BY r ORDER BY i) AS e FROM t1),
nt AS (SELECT term, count(DISTINCT r) AS n_term FROM t WHERE term IN (SELECT term FROM p) GROUP BY term),
sh AS (SELECT kind, value, term, CASE WHEN n > n_entity THEN round(ln(CAST(n AS DOUBLE) * n_pair / (n_entity * CAST(n_term AS DOUBLE))) / ln(CAST(n AS DOUBLE) / n_entity), 9) ELSE 0 END AS disclosure
       FROM p JOIN ne USING (kind, value) JOIN nt USING (term), (SELECT count(*) AS n FROM d)),
y AS (SELECT t.r, t.term, e, max(disclosure) AS disclosure FROM t JOIN sh ON sh.term = t.term AND disclosure >= 0.9 JOIN (SELECT DISTINCT r, kind, value FROM b) own ON own.r = t.r AND own.kind = sh.kind AND own.value = sh.value GROUP BY ALL),
x AS (SELECT r, CASE WHEN disclosure >= 0.95 THEN 'remove' ELSE 'generalise' END AS kind, CASE WHEN disclosure >= 0.95 THEN 6 ELSE 5 END AS o, CAST(e - length(term) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM y),
l AS (SELECT r, kind, o, s, e FROM b UNION ALL SELECT r, kind, o, s, e FROM x WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.r = x.r AND b.s < x.e AND b.e > x.s)),
z AS (SELECT r, count(*) FILTER (WHERE o = 1) AS n_email, count(*) FILTER (WHERE o = 2) AS n_ip, count(*) FILTER (WHERE o = 3) AS n_card, count(*) FILTER (WHERE o = 4) AS n_phone,
             string_agg(concat(kind, ':', s, ':', e), ',' ORDER BY o, s) FILTER (WHERE o < 5) AS base, string_agg(concat(kind, ':', s, ':', e), ',' ORDER BY o, s) AS spans FROM l GROUP BY r)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN z USING (r)
"""


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """A tenth of the documents repeat words from some place on, as crc32 of their id says; the others' texts stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        place = F.struct(n.alias("n"), a.alias("a"), p.alias("p"))
        words = F.transform(F.array(place), lambda x: F.transform(F.sequence(F.lit(0).cast("long"), x.n - 1), lambda i: F.get(w, F.when(i < x.a, i).otherwise(x.a + (i - x.a) % x.p).cast("int"))))
        return F.when(n > 0, F.array_join(words[0], " ")).otherwise("")

    return docs.select("doc_id", F.when(h % 10 == 0, F.transform(F.array(words(F.col("text"))), repeated)[0]).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(_with_planted_runs(_table(spark, sf_dir, "documents")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r.length).alias("shorter"), r.start.alias("start"), r.period.alias("period"), r.length.alias("length"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start"),
        F.col("best.length"),
        F.col("best.period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_middle.fill_middle(_table(spark, sf_dir, "documents"), seed=7, rate=100, spm=50)
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


ORACLE_SQL["op13_fill_middle"] = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256(concat('7:', doc_id)) AS h FROM documents),
r AS (SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS UBIGINT) AS h1, CAST('0x' || h[9:16] AS UBIGINT) AS h2, CAST('0x' || h[25:32] AS UBIGINT) AS h4 FROM t),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM r),
s AS (SELECT *, array_to_string(u[1:low], '') AS prefix, array_to_string(u[low + 1:high], '') AS middle, array_to_string(u[high + 1:n], '') AS suffix FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM s
"""


for _query in (op1_url_filter, op2_exact_dedup, op3_lm_score, op4_decontaminate, op5_warc, op6_ngram_join, op7_mix_sources, op8_html_extract, op9_language_id, op10_substring_dedup, op11_disclosure, op12_periodic_runs, op13_fill_middle):
    QUERIES[_query.__name__] = _query
