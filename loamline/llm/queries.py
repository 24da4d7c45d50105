"""The registered queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.llm import chat_collapse, decontamination, embedding_forest, fill_middle, license_scan, line_dedup, minhash_dedup, mixing, quality_crf, quartile_digest, structure_repair, url_filters, warc_bundles
from loamline.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents by sets of four-word shingles."""
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4, percent=80)


ORACLES["op8_minhash_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) END) AS sh FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS MATERIALIZED (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * p.c >= 80 * (na.n + nb.n - p.c)
), r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, g.c AS component_id, d.doc_id = g.c AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT x, min(y) AS c FROM r GROUP BY x) g ON g.x = d.doc_id
"""


URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@query
def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page, by the rules or else by path templates."""
    return url_filters.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


@query
def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every maximal conversation as ChatML."""
    return chat_collapse.maximal_chats(table(spark, sf_dir, "conversations"))


ORACLES["op4_chat_formatting"] = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS LAST, text NULLS LAST) AS p,
    '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS r,
    {'role': role, 'text': text} AS c
  FROM conversations
), u AS (
  SELECT conv_id, p, list(c) OVER (PARTITION BY conv_id ORDER BY p) AS pre FROM t
), w AS (SELECT conv_id, count(*) AS n_turns, string_agg(r, '' ORDER BY p) AS chat, list(c ORDER BY p) AS whole FROM t GROUP BY conv_id),
i AS (SELECT DISTINCT u.pre FROM u JOIN w USING (conv_id) WHERE u.p < w.n_turns)
SELECT min(conv_id) AS conv_id, max(n_turns)::BIGINT AS n_turns, count(*) AS n_copies, min(chat) AS chat
FROM w WHERE whole NOT IN (SELECT pre FROM i) GROUP BY whole
"""


@query
def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of ten words in every document, exact and, for n_near, with a word missing or words off their places by three at most."""
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10, near=(1, 3))


ORACLES["op5_benchmark_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), k AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS win FROM b WHERE len(w) > 0
), ns AS (SELECT DISTINCT n FROM k),
g AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS s, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS win FROM d, ns WHERE len(w) >= n
), h AS (SELECT g.doc_id, g.s, g.n, k.item FROM g JOIN k ON g.win = k.win AND g.n = k.n),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY 1),
x AS (
  SELECT DISTINCT array_to_string(t, ' ') AS win, t, len(t) - greatest(0, least(1, len(t) - 2)) AS need FROM (SELECT w[i:i + 9] AS t FROM (SELECT w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0))
), o AS (SELECT win, need, unnest(range(0, len(t))) AS k, unnest(t) AS term FROM x),
pl AS (SELECT doc_id, unnest(range(0, len(w))) AS pos, unnest(w) AS term FROM d),
likely AS MATERIALIZED (SELECT doc_id, win FROM (SELECT DISTINCT doc_id, term FROM pl) JOIN o USING (term) GROUP BY doc_id, win, need HAVING count(DISTINCT k) >= need),
m AS (SELECT DISTINCT doc_id, win, need, k, pos - k + j AS s FROM likely JOIN o USING (win) JOIN pl USING (doc_id, term), (SELECT unnest(range(-3, 4)) AS j)),
nn AS (SELECT doc_id, count(DISTINCT win) AS n_near FROM (SELECT doc_id, win FROM m GROUP BY doc_id, win, need, s HAVING count(*) >= need) GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(i.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(i.items, '')) AS items_sha256, coalesce(n_near, 0)::BIGINT AS n_near, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id) LEFT JOIN nn USING (doc_id)
"""


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mix of all sources at weights 5, 2, 1 in turn."""
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(5.0, 2.0, 1.0), cap=3, seed=42)


ORACLES["op10_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    (('0x' || substr(md5('42:' || doc_id), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents
), s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size, sum(size * ln(1 + size)) AS weighted,
    [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source
), s1 AS (
  SELECT *, source_size * 3.0::DOUBLE AS cap FROM s0
), s2 AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
  FROM s1 WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), s3 AS (
  SELECT *, least(cap, coalesce(max(CASE WHEN level * w <= cap THEN level END) OVER () * w, cap)) AS target FROM s2
), s4 AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size + 1e-9), 3) ELSE 0 END::BIGINT AS copies FROM s3
), s5 AS (SELECT *, greatest(target - copies * source_size, 0) AS rest FROM s4),
p AS (
  SELECT d.*, source_size, target, copies, rest,
    least(CASE WHEN source_size > 0 THEN rest / source_size ELSE 0 END * ln(1 + size) / greatest(weighted / greatest(source_size, 1), 1e-9), 0.999999) AS p
  FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source
), q AS (SELECT *, CASE WHEN rest > 0 AND size > 0 AND copies < 3 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM p),
r AS (SELECT *, coalesce(sum(CASE WHEN q IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q)
SELECT doc_id, size, source_size, target,
  (size * (copies + CASE WHEN q IS NOT NULL AND before + size / 2 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""


@query
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, by a model trained on labelled ones that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return quality_crf.score_documents(docs, quality_crf.train(docs, table(spark, sf_dir, "labels")))


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the later copies of repeated line runs of 50 words or more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_repeated_runs(docs, min_words=50).select("doc_id", "text", "_runs.n_lines", "_runs.n_removed", "_runs.runs")


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to seekable WARC bundles and read back."""
    return warc_bundles.archive_round_trip(table(spark, sf_dir, "pages"), least_bytes=100)


ORACLES["op6_warc"] = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS f FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest,
  CASE WHEN f.f <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN f.f <> page_id THEN f.f END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""


@query
def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartile digests of every text and of its edited text."""
    return quartile_digest.fingerprints(table(spark, sf_dir, "documents"))


@query
def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in all documents."""
    docs = table(spark, sf_dir, "documents")
    return license_scan.scan(docs, license_scan.fit(license_scan.sample_lines(docs, 2000)))


def fim_digests(docs: DataFrame) -> DataFrame:
    """doc_id, units, form, lengths and digests of the fill-in-middle output, and of the text restored from it."""
    out = fill_middle.fill_in_middle(docs.select("doc_id", "text"))
    sha = lambda c: F.sha2(c, 256)
    restored = fill_middle.restored(F.col("fim.output"), F.col("fim.form"))
    return out.select("doc_id", "fim.n", "fim.form", F.length("fim.prefix").cast("long").alias("prefix_chars"), F.length("fim.middle").cast("long").alias("middle_chars"), sha(F.col("fim.output")).alias("output_sha256"), sha(restored).alias("restored_sha256"))


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-middle form of every whole text."""
    return fim_digests(table(spark, sf_dir, "documents"))


ORACLES["op11_fill_in_middle"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), k AS (
  SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k
), p AS (
  SELECT *, array_to_string(u[1:lo], '') AS a, array_to_string(u[lo + 1:hi], '') AS b, array_to_string(u[hi + 1:n], '') AS c FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE a || b || c END) AS restored_sha256
FROM p
"""


@query
def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, damaged by a fixed rule."""
    conversations = table(spark, sf_dir, "conversations")
    return structure_repair.repair_report(conversations, structure_repair.damaged(conversations))


ORACLES["op12_structure_repair"] = r"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS id FROM conversations
), dam AS (
  SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(id) + 1), lambda i: [ascii(id[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295) % 20 AS d FROM k
), rws AS (
  SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(0, CASE d WHEN 3 THEN 2 ELSE 1 END)) AS cp
  FROM dam WHERE d <> 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, cp) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM rws
), f AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS two FROM o
), nx(a, r, b) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
ins AS (
  SELECT s AS a, s AS b, '' AS e FROM range(0, 4) t(s) UNION ALL SELECT a, b, 'I' FROM nx WHERE r <> 's' UNION ALL SELECT x.a, y.b, 'II' FROM nx x JOIN nx y ON x.b = y.a WHERE x.r <> 's' AND y.r <> 's'
), mv AS (
  SELECT i.a, i.b AS g, i.e FROM ins i
), ed AS (
  SELECT f.conv_id, f.i, m.a, n.b, 3 * len(m.e) + CASE fault WHEN 'truncated' THEN 3 ELSE 0 END + CASE WHEN z.op = 'R' THEN 3 ELSE 0 END AS cost, m.e || z.op AS e
  FROM f JOIN mv m ON true JOIN (VALUES ('K'), ('R')) z(op) ON fault NOT IN ('blank', 'duplicate') JOIN nx n ON n.a = m.g AND ((z.op = 'K' AND n.r = left(role, 1)) OR (z.op = 'R' AND n.r <> 's'))
  UNION ALL SELECT f.conv_id, f.i, m.a, m.g, 3 * len(m.e) + 4, m.e || 'D' FROM f JOIN mv m ON true
), dp AS (
  SELECT DISTINCT conv_id, 0 AS i, 0 AS s, {'cost': 0::BIGINT, 'audit': ''} AS m FROM f
  UNION ALL
  SELECT dp.conv_id, dp.i + 1, ed.b, min({'cost': dp.m.cost + ed.cost, 'audit': dp.m.audit || ed.e}) FROM dp JOIN ed ON dp.conv_id IS NOT DISTINCT FROM ed.conv_id AND ed.i = dp.i + 1 AND ed.a = dp.s GROUP BY dp.conv_id, dp.i, ed.b
), g AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal, list({'role': role, 'text': text} ORDER BY i) AS turns FROM f GROUP BY conv_id
), fin AS (
  SELECT g.conv_id, min({'cost': dp.m.cost + 3 * len(ins.e), 'audit': dp.m.audit || ins.e}) AS m FROM g JOIN dp ON g.conv_id IS NOT DISTINCT FROM dp.conv_id AND dp.i = g.n JOIN ins ON ins.a = dp.s AND ins.b IN (0, 3) GROUP BY g.conv_id
), ap AS (
  SELECT g.conv_id, fin.m, g.turns, 1 AS p, 1 AS r, 0 AS s, []::VARCHAR[] AS lines FROM g JOIN fin ON g.conv_id IS NOT DISTINCT FROM fin.conv_id
  UNION ALL
  SELECT conv_id, m, turns, p + 1, r + CASE WHEN m.audit[p] = 'I' THEN 0 ELSE 1 END,
    CASE WHEN m.audit[p] = 'D' THEN s WHEN m.audit[p] = 'K' AND left(turns[r].role, 1) = 's' THEN 1 WHEN s = 2 THEN 3 ELSE 2 END,
    CASE m.audit[p] WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, turns[r].role || ':' || turns[r].text) WHEN 'R' THEN list_append(lines, CASE WHEN s = 2 THEN 'assistant:' ELSE 'user:' END || turns[r].text) ELSE list_append(lines, CASE WHEN s = 2 THEN 'assistant:' ELSE 'user:' END) END
  FROM ap WHERE p <= length(m.audit)
), sh AS (SELECT conv_id, m, sha256(array_to_string(lines, chr(10))) AS h FROM ap WHERE p > length(m.audit))
SELECT c.conv_id, coalesce(g.gaps, 0)::BIGINT AS gaps, coalesce(g.blank, 0)::BIGINT AS blank, coalesce(g.duplicate, 0)::BIGINT AS duplicate, coalesce(g.truncated, 0)::BIGINT AS truncated,
  coalesce(g.illegal, 0)::BIGINT AS illegal, coalesce(sh.m.cost, 0)::BIGINT AS cost, coalesce(sh.m.audit, '') AS audit, coalesce(sh.h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN sh ON sh.conv_id IS NOT DISTINCT FROM c.conv_id
"""


@query
def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors with equal labels and a cosine of 0.93 or more."""
    return embedding_forest.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


ORACLES["op13_embedding_near_dedup"] = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), ok AS (
  SELECT *, sqrt(list_dot_product(e, e)) AS n FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93
), r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a)
SELECT v.vec_id, coalesce(n.c, 0)::BIGINT AS n_links, g.c AS component_id, v.vec_id = g.c AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS c FROM l GROUP BY a) n ON n.a = v.vec_id JOIN (SELECT x, min(y) AS c FROM r GROUP BY x) g ON g.x = v.vec_id
"""
