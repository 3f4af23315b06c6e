"""The thin ``opN_<name>`` queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmesh.llm import langid, quality_classifier, toxicity
from inkmesh.llm.common import read_table, shared_dir
from inkmesh.llm.compression_rules import compression_rules, fit_bands
from inkmesh.llm.decontaminate import decontaminate
from inkmesh.llm.divergence import source_divergence
from inkmesh.llm.hamming_join import hamming_join
from inkmesh.llm.lsh_forest import jaccard_join
from inkmesh.llm.packing import pack
from inkmesh.llm.secret_scan import scan_secrets, spelled
from inkmesh.llm.secret_scan_sql import secret_scan_sql
from inkmesh.llm.substring_dedup import repeated_passages
from inkmesh.llm.target_encoding import sale_encodings
from inkmesh.llm.warc_zst import read_archives, write_archives


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_classifier.classify_quality(docs, quality_classifier.fit(docs)).select("doc_id", "quality_class.*")


def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(read_table(spark, sf_dir, "documents"))
    return found.withColumnsRenamed({"id": "doc_id", "other_id": "match_doc_id", "other_start_word": "match_start_word", "other_end_word": "match_end_word"})


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), train_where=~toxicity.held_out())
    return toxicity.score_toxicity(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "toxicity.*")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    samples = langid.learn(docs, train_where=~langid.held_out())
    return langid.identify_language(docs.drop("lang"), samples).select("doc_id", langid.held_out().alias("held_out"), "language.*")


def op5_compression_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    document_bands, chunk_bands = fit_bands(docs)
    return compression_rules(docs, document_bands=document_bands, chunk_bands=chunk_bands).select("doc_id", "rules.*")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate(docs, read_table(spark, sf_dir, "benchmark"))
    r = F.col("decontamination")
    return out.select(
        "doc_id", r["n_words"].alias("n_words"), r["n_hit"].alias("n_hit"), F.size(r["item_ids"]).cast("long").alias("n_items"), F.sha2(F.array_join(r["item_ids"], ","), 256).alias("items_sha256"), r["contaminated"].alias("contaminated")
    )


OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item, m, array_to_string(w[s:s + m - 1], ' ') AS win
  FROM (SELECT item, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM (SELECT item, w, least(13, len(w)) AS m FROM b WHERE len(w) > 0))),
lengths AS (SELECT DISTINCT m FROM windows),
places AS (
  SELECT rid, m, s, array_to_string(w[s:s + m - 1], ' ') AS win
  FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, lengths WHERE len(w) >= m)),
hits AS (SELECT p.rid, p.s, p.m, x.item FROM places p JOIN windows x ON p.m = x.m AND p.win = x.win),
marked AS (SELECT rid, count(DISTINCT i) AS n_hit FROM (SELECT rid, unnest(range(s, s + m)) AS i FROM hits) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN marked USING (rid) LEFT JOIN items USING (rid)
"""


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    folder = shared_dir(spark)
    manifest = write_archives(pages, folder)
    kind = pages.schema["page_id"].dataType
    records = read_archives(manifest, folder, with_payload=False)
    number = lambda c: F.when(F.col(c) != "", F.col(c)).cast(kind).alias(c)
    return records.select(number("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to"))


OP7_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
digit AS (SELECT page_id, payload_bytes, hex, [CAST('0x' || hex[1 + 10 * g:10 + 10 * g] AS BIGINT) FOR g IN range(4)] AS v FROM p),
d AS (
  SELECT page_id, payload_bytes, hex,
         array_to_string([array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((x >> CAST(35 - 5 * k AS BIGINT)) & 31) + 1 AS BIGINT), 1) FOR k IN range(8)], '') FOR x IN v], '') AS payload_digest
  FROM digit),
owner AS (SELECT hex, max(page_id) AS owner FROM p GROUP BY hex)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM owner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM owner THEN owner END AS refers_to
FROM d JOIN owner USING (hex)
"""


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scan_secrets(docs).select("doc_id", F.col("secrets.spans").alias("s"))
    n = lambda kind: F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long")
    return out.select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(spelled(F.filter("s", lambda x: x["kind"] != "random")), 256).alias("base_sha256"), spelled(F.col("s")).alias("spans"), n("random").alias("n_random")
    )


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, _ = jaccard_join(read_table(spark, sf_dir, "documents"))
    return members.select(F.col("id").alias("doc_id"), "class_id", "n_links", "copy_of")


#: All pairs that share a shingle; the forest's links equal them where its buckets are small, as on the test tables.
OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(string_split_regex(lower(coalesce(text, '')), '[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda x: x <> '') AS w
  FROM documents),
shingle AS (SELECT DISTINCT rid, array_to_string(w[s:s + least(5, len(w)) - 1], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS s FROM d WHERE len(w) > 0)),
size AS (SELECT rid, count(*) AS n FROM shingle GROUP BY rid),
common AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM shingle a JOIN shingle b ON a.g = b.g AND a.rid <> b.rid GROUP BY 1, 2),
link AS (SELECT a, b, c = x.n AND c = y.n AS same FROM common JOIN size x ON x.rid = a JOIN size y ON y.rid = b WHERE c >= 0.8::DOUBLE * (x.n + y.n - c)),
reach(rid, other) AS (SELECT rid, rid FROM d UNION SELECT r.rid, l.b FROM reach r JOIN link l ON l.a = r.other),
class AS (SELECT r.rid, min(d.doc_id) AS class_id FROM reach r JOIN d ON d.rid = r.other GROUP BY r.rid),
copy AS (SELECT a AS rid, min(d.doc_id) AS low FROM link JOIN d ON d.rid = b WHERE same GROUP BY a),
degree AS (SELECT a AS rid, count(*) AS n FROM link GROUP BY a)
SELECT d.doc_id, class_id, coalesce(degree.n, 0) AS n_links, least(d.doc_id, coalesce(low, d.doc_id)) AS copy_of
FROM d JOIN class USING (rid) LEFT JOIN copy USING (rid) LEFT JOIN degree USING (rid)
"""


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = pack(docs, public_tokenizer())
    return pieces.select("doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens", "tier", "step_group")


def op11_target_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sale_encodings(*[read_table(spark, sf_dir, name) for name in ("sale_lines", "sales", "items", "vendors", "clients")])


OP11_SQL = """
WITH line AS (
  SELECT l.sale_id, coalesce(l.item_id, -1) AS item_id, l.vendor_id, coalesce(s.client_id, -1) AS client_id, s.sold_at,
         CAST(coalesce(l.flag = 'returned', false) AS BIGINT) AS hit,
         list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten([[CAST(ord(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0] FOR c IN string_split(CAST(l.sale_id AS VARCHAR), '')])),
                     lambda r, b: xor(xor(r, b) >> 1, 3988292384 * (xor(r, b) & 1))) AS register
  FROM sale_lines l JOIN sales s ON l.sale_id = s.sale_id WHERE s.sold_at IS NOT NULL),
own AS (
  SELECT sale_id, item_id, vendor_id, client_id, sold_at, xor(register, 4294967295) % 5 AS fold, count(*) AS n_lines, sum(hit) AS n_returned FROM line GROUP BY ALL),
wide AS (
  SELECT o.*, i.kind, v.nation_id, c.segment
  FROM own o LEFT JOIN items i ON i.item_id = o.item_id LEFT JOIN vendors v ON v.vendor_id = o.vendor_id LEFT JOIN clients c ON c.client_id = o.client_id),
history AS (
  SELECT *, coalesce(sum(n_lines) OVER (PARTITION BY true ORDER BY sold_at RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) - coalesce(sum(n_lines) OVER (PARTITION BY true, fold ORDER BY sold_at RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) AS all_n,
         coalesce(sum(n_returned) OVER (PARTITION BY true ORDER BY sold_at RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) - coalesce(sum(n_returned) OVER (PARTITION BY true, fold ORDER BY sold_at RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) AS all_s,
         coalesce(sum(n_lines) OVER (PARTITION BY item_id ORDER BY sold_at RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) - coalesce(sum(n_lines) OVER (PARTITION BY item_id, fold ORDER BY sold_at RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) AS item_n,
         coalesce(sum(n_returned) OVER (PARTITION BY item_id ORDER BY sold_at RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) - coalesce(sum(n_returned) OVER (PARTITION BY item_id, fold ORDER BY sold_at RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) AS item_s,
         coalesce(sum(n_lines) OVER (PARTITION BY vendor_id ORDER BY sold_at RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) - coalesce(sum(n_lines) OVER (PARTITION BY vendor_id, fold ORDER BY sold_at RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) AS vendor_n,
         coalesce(sum(n_returned) OVER (PARTITION BY vendor_id ORDER BY sold_at RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) - coalesce(sum(n_returned) OVER (PARTITION BY vendor_id, fold ORDER BY sold_at RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) AS vendor_s,
         coalesce(sum(n_lines) OVER (PARTITION BY client_id ORDER BY sold_at RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) - coalesce(sum(n_lines) OVER (PARTITION BY client_id, fold ORDER BY sold_at RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) AS client_n,
         coalesce(sum(n_returned) OVER (PARTITION BY client_id ORDER BY sold_at RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) - coalesce(sum(n_returned) OVER (PARTITION BY client_id, fold ORDER BY sold_at RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) AS client_s,
         coalesce(sum(n_lines) OVER (PARTITION BY kind ORDER BY sold_at RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) - coalesce(sum(n_lines) OVER (PARTITION BY kind, fold ORDER BY sold_at RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) AS kind_n,
         coalesce(sum(n_returned) OVER (PARTITION BY kind ORDER BY sold_at RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) - coalesce(sum(n_returned) OVER (PARTITION BY kind, fold ORDER BY sold_at RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) AS kind_s,
         coalesce(sum(n_lines) OVER (PARTITION BY nation_id ORDER BY sold_at RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) - coalesce(sum(n_lines) OVER (PARTITION BY nation_id, fold ORDER BY sold_at RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) AS nation_n,
         coalesce(sum(n_returned) OVER (PARTITION BY nation_id ORDER BY sold_at RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) - coalesce(sum(n_returned) OVER (PARTITION BY nation_id, fold ORDER BY sold_at RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) AS nation_s,
         coalesce(sum(n_lines) OVER (PARTITION BY segment ORDER BY sold_at RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) - coalesce(sum(n_lines) OVER (PARTITION BY segment, fold ORDER BY sold_at RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) AS segment_n,
         coalesce(sum(n_returned) OVER (PARTITION BY segment ORDER BY sold_at RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) - coalesce(sum(n_returned) OVER (PARTITION BY segment, fold ORDER BY sold_at RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) AS segment_s
  FROM wide),
g AS (SELECT *, CASE WHEN all_n < 1 THEN 500000 ELSE (1000000 * all_s + 50 * 500000) // (all_n + 50) END AS p FROM history),
m AS (SELECT *, CASE WHEN kind_n < 1 THEN p ELSE (1000000 * kind_s + 50 * p) // (kind_n + 50) END AS kind_p, CASE WHEN nation_n < 1 THEN p ELSE (1000000 * nation_s + 50 * p) // (nation_n + 50) END AS nation_p, CASE WHEN segment_n < 1 THEN p ELSE (1000000 * segment_s + 50 * p) // (segment_n + 50) END AS segment_p FROM g)
SELECT sale_id, item_id, vendor_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_returned AS BIGINT) AS n_returned, CAST(item_n AS BIGINT) AS item_n, CAST(CASE WHEN item_n < 1 THEN kind_p ELSE (1000000 * item_s + 50 * kind_p) // (item_n + 50) END AS BIGINT) AS item_rate, CAST(vendor_n AS BIGINT) AS vendor_n, CAST(CASE WHEN vendor_n < 1 THEN nation_p ELSE (1000000 * vendor_s + 50 * nation_p) // (vendor_n + 50) END AS BIGINT) AS vendor_rate, CAST(client_n AS BIGINT) AS client_n, CAST(CASE WHEN client_n < 1 THEN segment_p ELSE (1000000 * client_s + 50 * segment_p) // (client_n + 50) END AS BIGINT) AS client_rate
FROM m
"""


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(read_table(spark, sf_dir, "documents").select("text", "lang", "source"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+') AS w
  FROM documents),
word AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM word GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM d),
hit AS (SELECT lang, source, term, count(*) AS c FROM word JOIN kept USING (lang, term) GROUP BY ALL),
total AS (SELECT lang, source, sum(c) AS n FROM hit GROUP BY ALL),
of_group AS (
  SELECT g.lang, g.source, k.term, coalesce(h.c, 0) AS c,
         1 + CAST(1000000000 AS HUGEINT) * (coalesce(h.c, 0) + 5) // (coalesce(t.n, 0) + 5 * s.v) AS p
  FROM grp g JOIN kept k USING (lang) JOIN size s USING (lang) LEFT JOIN hit h USING (lang, source, term) LEFT JOIN total t USING (lang, source)),
of_lang AS (
  SELECT lang, term, 1 + CAST(1000000000 AS HUGEINT) * (sum(c) + 5) // (max(n) + 5 * max(v)) AS q
  FROM hit JOIN size USING (lang) JOIN (SELECT lang, sum(n) AS n FROM total GROUP BY lang) USING (lang) GROUP BY lang, term),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM of_group a JOIN of_group b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
term AS (SELECT lang, source, term AS item, p - q AS value FROM of_group JOIN of_lang USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS rank FROM pair
  UNION ALL
  SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS rank FROM term)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


def op13_hamming_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, _ = hamming_join(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return members.withColumnRenamed("id", "doc_id")


#: All pairs that share a shingle.  The join misses a pair at the threshold with a chance of four in a million.
OP13_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{20}\x{09}-\x{0D}]+') AS w
  FROM documents),
shingle AS (SELECT DISTINCT rid, array_to_string(w[s:s + least(2, len(w)) - 1], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - least(2, len(w)) + 2)) AS s FROM d WHERE len(w) > 0)),
size AS (SELECT rid, count(*) AS n FROM shingle GROUP BY rid),
common AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM shingle a JOIN shingle b ON a.g = b.g AND a.rid <> b.rid GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN size x ON x.rid = a JOIN size y ON y.rid = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(rid, other) AS (SELECT rid, rid FROM d UNION SELECT r.rid, l.b FROM reach r JOIN link l ON l.a = r.other),
least_id AS (SELECT r.rid, min(d.doc_id) AS component_id FROM reach r JOIN d ON d.rid = r.other GROUP BY r.rid)
SELECT d.doc_id, CAST(coalesce(size.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id IS NOT DISTINCT FROM component_id AS kept
FROM d JOIN least_id USING (rid) LEFT JOIN size USING (rid)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_repeated_passages": op2_repeated_passages,
        "op3_toxicity": op3_toxicity,
        "op4_langid": op4_langid,
        "op5_compression_rules": op5_compression_rules,
        "op6_decontaminate": op6_decontaminate,
        "op7_warc": op7_warc,
        "op8_secret_scan": op8_secret_scan,
        "op9_jaccard_join": op9_jaccard_join,
        "op10_pack": op10_pack,
        "op11_target_encoding": op11_target_encoding,
        "op12_source_divergence": op12_source_divergence,
        "op13_hamming_join": op13_hamming_join,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_decontaminate": OP6_SQL, "op7_warc": OP7_SQL, "op8_secret_scan": secret_scan_sql(), "op9_jaccard_join": OP9_SQL, "op11_target_encoding": OP11_SQL, "op12_source_divergence": OP12_SQL, "op13_hamming_join": OP13_SQL}
