"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    byte_bpe, capfilter, chat, decontam, filter_audit, lexical, linededup, pieces, quality, secret_scan, simhash, toxicity, warc,
)
from tidemark.llm.common import scratch_path, table

THRESHOLD = 0.3


def held_out(of: int, rest: int):
    """``doc_id`` as text has this remainder of its CRC-32."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of == rest, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, target: str, of: int, rest: int) -> DataFrame:
    """``(doc_id, y)`` of the labels that may be learned from."""
    return (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y"))
            .where(~held_out(of, rest)).where("doc_id is not null and y is not null"))


def scored(scores: DataFrame, of: int, rest: int) -> DataFrame:
    return scores.select("doc_id", held_out(of, rest).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op1_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(table(spark, sf_dir, "conversations"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.ToxicityModel:
    known = labelled(docs, table(spark, sf_dir, "labels"), "toxic", 4, 2)
    return toxicity.ToxicityModel.fit(docs, known)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(toxicity_model(spark, docs, sf_dir).score(docs), 4, 2)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(quality.quality_scores(docs, labelled(docs, table(spark, sf_dir, "labels"), "quality", 5, 0)), 5, 0)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs, least=10).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capfilter.cosine_groups(table(spark, sf_dir, "embeddings"), least=0.93)


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    base = F.filter("findings", lambda x: x["kind"] != "model")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind):
        return F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(kind) for kind in secret_scan.KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))


def op9_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, f"archives-{uuid.uuid4().hex}")
    warc.write_archives(warc.plan_records(table(spark, sf_dir, "pages")), path)
    back = warc.read_archives(spark, path).where(F.col("record_type").isin("response", "revisit"))
    full = F.col("record_type") == "response"
    return back.select(
        "page_id", F.when(full, F.length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(full, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), shingle=5, least=0.8)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents")))
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_chat_perspectives, op2_simhash_dedup, op3_toxicity, op4_quality, op5_line_dedup, op6_embedding_dedup, op7_pieces,
    op8_secret_scan, op9_warc_round_trip, op10_decontamination, op11_filter_audit, op12_lexical_search, op13_byte_bpe,
    pipeline)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = (f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')")

_TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"

ORACLE: dict[str, str] = {
    "op1_chat_perspectives": """
WITH said AS (SELECT conv_id, turn, role, coalesce(text, '') AS body FROM conversations),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, body) - 1 AS i FROM said),
speakers AS (SELECT DISTINCT conv_id AS c, role AS speaker FROM said WHERE role IS NOT NULL AND role <> 'system'),
seen AS (SELECT conv_id, speaker, i // 512 AS part, i, coalesce(role = speaker, false) AS own,
  '<|im_start|>' || CASE WHEN coalesce(role = speaker, false) THEN 'assistant' WHEN role IS NULL THEN 'user'
    WHEN role = 'system' THEN 'system' ELSE 'user name=' || regexp_replace(role, '[\\s<|>]', '_', 'g') END || chr(10) AS head,
  replace(body, '<|', '< |') || '<|im_end|>' AS said
  FROM numbered JOIN speakers ON conv_id IS NOT DISTINCT FROM c),
ends AS (SELECT *, sum(length(head) + length(said) + 1) OVER (PARTITION BY conv_id, speaker, part ORDER BY i) - 1 AS e FROM seen)
SELECT conv_id, speaker, CAST(part AS BIGINT) AS part, count(*) AS n_messages, string_agg(head || said || chr(10), '' ORDER BY i) AS text,
  coalesce(string_agg(CASE WHEN own THEN CAST(e - length(said) AS VARCHAR) || ':' || CAST(e AS VARCHAR) END, ',' ORDER BY i), '') AS mask
FROM ends GROUP BY ALL""",
    "op5_line_dedup": f"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS k FROM lines),
dup AS (SELECT k, min(doc_id) AS holder FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT doc_id, i, line, coalesce(doc_id <> holder, false) AS gone FROM keyed LEFT JOIN dup USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op9_warc_round_trip": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)""",
    "op10_decontamination": f"""
WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(2, len(w) - 3)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM dw WHERE len(w) > 0),
si AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(2, len(w) - 3)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM iw WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n_item FROM si GROUP BY ALL),
hit AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN si USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment FROM hit JOIN n USING (item_id)
WHERE n_shared >= greatest(1, ceil(round(0.8 * n_item, 9)))""",
    "op11_filter_audit": """
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(x, '[\\x20\\x09-\\x0D]+'), lambda v: v <> '') AS words FROM t),
first AS (SELECT x, min(doc_id) AS id FROM t GROUP BY x),
d AS (SELECT part, [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words),
    100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 5 * length(x), regexp_matches(x, '[#$%&*|]'),
    coalesce(doc_id > id, false)] AS f,
  EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = w.doc_id AND quality = 1) AS good,
  EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = w.doc_id AND toxic = 1) AS bad
  FROM w JOIN first USING (x)),
cells AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (bad) AS b FROM d GROUP BY ALL),
letters AS (SELECT unnest(range(1, 6)) AS v),
orders AS (SELECT [a.v, b.v, c.v, e.v, h.v] AS o FROM letters a, letters b, letters c, letters e, letters h
  WHERE len(list_distinct([a.v, b.v, c.v, e.v, h.v])) = 5),
steps AS (SELECT o, array_to_string(list_transform(o, lambda v: substr('ABCDE', CAST(v AS INTEGER), 1)), '') AS filter_order, step,
    o[step] AS own, o[1:step - 1] AS prior FROM orders, (SELECT unnest(range(1, 6)) AS step)),
hit AS (SELECT *, f[own] AS fails, len(list_filter(prior, lambda v: f[v])) > 0 AS gone, len(list_filter(f, lambda v: v)) AS n_fails
  FROM steps, cells),
r AS (SELECT part, filter_order, step, own, CAST(coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS BIGINT) AS kept,
  CAST(coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (fails AND gone), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(n) FILTER (fails AND n_fails = 1), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(g) FILTER (fails AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(b) FILTER (fails AND NOT gone), 0) AS BIGINT) AS toxic_lost
  FROM hit GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r""",
    "op12_lexical_search": f"""
WITH dt AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_TERM}) AS t FROM documents),
s AS (SELECT count(*) FILTER (len(t) > 0) AS nd, CAST(sum(len(t)) AS BIGINT) AS total FROM dt),
want AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_TERM})) AS term FROM benchmark),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM dt)
  WHERE term IN (SELECT term FROM want) GROUP BY ALL),
df AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY term, nd),
impact AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // total))) AS v FROM tf JOIN df USING (term), s),
scores AS (SELECT item_id, r, doc_id, CAST(sum(v) AS BIGINT) AS score FROM want JOIN impact USING (term) GROUP BY ALL HAVING sum(v) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM scores QUALIFY rank <= 50""",
}
