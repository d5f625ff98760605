"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.llm import bpe, byte_repeats, collocations, conversations, decontaminate, exact_dedup, knn, language_crf, mixing, simhash, toxicity, warc, word_repeats
from affinis.llm.common import scratch_path, table

#: The folder of the public tokenizers; a parameter of the environment.
TOKENIZERS = os.environ.get("AFFINIS_TOKENIZERS", "/opt/tokenizers")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    return f"{TOKENIZERS}/{name}"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_crf.language(table(spark, sf_dir, "documents"))


def op3_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_warc(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return warc.read_warc(spark, manifest, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op6_word_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_repeats.dedup_words(table(spark, sf_dir, "documents"))


def op7_byte_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_repeats.dedup_bytes(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_groups(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    original = table(spark, sf_dir, "conversations")
    return conversations.reports(conversations.repair(conversations.damaged(original)), original)


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_bpe, op2_language, op3_knn, op4_mixing, op5_warc, op6_word_repeats, op7_byte_repeats, op8_exact_dedup, op9_toxicity,
        op10_simhash, op11_conversations, op12_decontaminate, op13_collocations,
    )
}

KNN_SQL = """
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE) for x in embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.e, d.e)::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""

MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5('mix' || doc_id) AS k FROM documents
), s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS source_no FROM d GROUP BY source
), s1 AS (
  SELECT *, (source_no - 1) % 3 + 1 AS w, 3 * source_size AS cap, sum(source_size) OVER () AS total FROM s0
), s2 AS (
  SELECT *, row_number() OVER o AS place, coalesce(sum(cap) OVER (ORDER BY cap / w, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(w) OVER (ORDER BY cap / w, source_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM s1 WINDOW o AS (ORDER BY cap / w, source_no)
), s3 AS (
  SELECT *, (total - before)::DOUBLE / rest AS level FROM s2
), s4 AS (
  SELECT *, min(place) FILTER (level <= cap / w) OVER () AS first, min_by(level, place) FILTER (level <= cap / w) OVER () AS share FROM s3
), s AS (
  SELECT source, source_size, source_no, total, CASE WHEN place >= first THEN share * w ELSE cap::DOUBLE END AS target FROM s4
), p AS (
  SELECT doc_id, size, source_size, source_no, target, total, sum(size) OVER (PARTITION BY source_no ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS place
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source
), e AS (
  SELECT *, ((c - 1) * source_size + place)::DOUBLE / target AS finish FROM p, (VALUES (1), (2), (3)) n(c) WHERE size > 0
), r AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source_no, c, place ROWS UNBOUNDED PRECEDING) AS running FROM e
), t AS (
  SELECT doc_id, source_no, place, sum(size) AS taken FROM r WHERE running <= total GROUP BY ALL
)
SELECT p.doc_id, p.size::BIGINT AS size, p.source_size, p.target, coalesce(t.taken, 0)::BIGINT AS taken
FROM p LEFT JOIN t ON p.doc_id = t.doc_id AND p.source_no = t.source_no AND p.place = t.place AND p.size > 0
"""

WARC_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages
), g AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload) AS first FROM p
)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(hex, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1) for i in range(0, 32)], '') AS payload_digest,
  CASE WHEN page_id = first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first OR first IS NULL THEN NULL ELSE first END AS refers_to
FROM g
"""

DEDUP_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS normal FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY normal ORDER BY length(text) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY normal) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(normal) AS text_sha256 FROM g
"""

WORDS_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20
), g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS x FROM s
), r AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS n FROM g
), c AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM r WHERE n > 1
), gone AS (
  SELECT doc_id, list(j) AS js FROM c GROUP BY doc_id
), flat AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d
), kept AS (
  SELECT f.doc_id, string_agg(f.word, ' ' ORDER BY f.j) AS rest FROM flat f ANTI JOIN c ON f.doc_id = c.doc_id AND f.j = c.j GROUP BY f.doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

CONVERSATIONS_SQL = r"""
WITH RECURSIVE o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    -- CRC-32 of the ASCII name: each byte goes in, then eight shifts
    xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten([[ord(b)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]
        for b in string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '')])),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) % 20 AS k FROM conversations
), d AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM o, (VALUES (0), (1)) c(copy) WHERE k <> 0 AND (copy = 0 OR k = 3)
), p AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(role), encode(text)) AS place FROM d
), r AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) AS nth, role[1] AS initial FROM p
), f AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY place) || initial AS pair FROM r
), stats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(place) AS places FROM f GROUP BY conv_id
), step(s, edit, t, name) AS (VALUES (0, 'I', 2, 'user'), (1, 'I', 2, 'user'), (3, 'I', 2, 'user'), (2, 'I', 3, 'assistant'),
  (0, 'R', 2, 'user'), (1, 'R', 2, 'user'), (3, 'R', 2, 'user'), (2, 'R', 3, 'assistant'),
  (0, 'D', 0, ''), (1, 'D', 1, ''), (2, 'D', 2, ''), (3, 'D', 3, ''), (0, 's', 1, ''), (0, 'u', 2, ''), (1, 'u', 2, ''), (3, 'u', 2, ''), (2, 'a', 3, '')
), w(conv_id, place, s, best) AS (
  SELECT conv_id, 0::BIGINT, 0, {'cost': 0::BIGINT, 'audit': '', 'rest': ''} FROM stats
  UNION ALL
  SELECT conv_id, place, t, min({'cost': cost, 'audit': audit, 'rest': rest}) FROM (
    SELECT i.conv_id, i.place + 1 AS place, p.t, i.best.cost + CASE p.edit WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END
        + CASE WHEN p.edit <> 'D' AND f.fault = 'truncated' THEN 5 ELSE 0 END AS cost,
      i.best.audit || CASE WHEN p.edit IN ('D', 'R') THEN p.edit ELSE 'K' END AS audit,
      i.best.rest || CASE WHEN p.edit = 'D' THEN '' ELSE chr(10) || CASE WHEN p.edit = 'R' THEN p.name ELSE f.role END || ':' || f.text END AS rest
    FROM (
      SELECT conv_id, place, s, best FROM w
      UNION ALL SELECT conv_id, place, t, {'cost': best.cost + 5, 'audit': best.audit || 'I', 'rest': best.rest || chr(10) || name || ':'} FROM w JOIN step USING (s) WHERE edit = 'I'
      UNION ALL SELECT conv_id, place, 3, {'cost': best.cost + 10, 'audit': best.audit || 'II', 'rest': best.rest || chr(10) || 'user:' || chr(10) || 'assistant:'} FROM w WHERE s <> 2
    ) i JOIN f ON f.conv_id IS NOT DISTINCT FROM i.conv_id AND f.place = i.place + 1
    JOIN step p ON p.s = i.s AND (p.edit = 'D' OR (f.fault NOT IN ('blank', 'duplicate') AND (p.edit = 'R' OR p.edit = f.initial)))
  ) x GROUP BY conv_id, place, t
), fin AS (
  SELECT conv_id, min(best) AS best FROM (
    SELECT conv_id, place, s, best FROM w
    UNION ALL SELECT conv_id, place, 3, {'cost': best.cost + 5, 'audit': best.audit || 'I', 'rest': best.rest || chr(10) || 'assistant:'} FROM w WHERE s = 2
    UNION ALL SELECT conv_id, place, 3, {'cost': best.cost + 10, 'audit': best.audit || 'II', 'rest': best.rest || chr(10) || 'user:' || chr(10) || 'assistant:'} FROM w WHERE s <> 2
  ) e JOIN stats USING (conv_id) WHERE place = places AND s IN (0, 3) GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(best.rest[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN stats USING (conv_id) LEFT JOIN fin USING (conv_id)
"""

DECONTAMINATE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS x
  FROM (SELECT item, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT row, i, size, array_to_string(w[i:i + size - 1], ' ') AS x
  FROM (SELECT row, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)
), h AS (
  SELECT row, i, size, item FROM dw JOIN bw USING (size, x)
), hits AS (
  SELECT row, count(DISTINCT j) AS n_hit FROM (SELECT row, unnest(range(i, i + size)) AS j FROM h) GROUP BY row
), items AS (
  SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY encode(item)) AS names FROM (SELECT DISTINCT row, item FROM h) GROUP BY row
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (row) LEFT JOIN items USING (row)
"""

COLLOCATIONS_SQL = r"""
WITH p AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), n AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang
), f AS (
  SELECT lang, size, phrase, count(*) AS f FROM (
    SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
    FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM p, range(1, 6) t(size) WHERE len(w) >= size)
  ) GROUP BY ALL HAVING count(*) >= 100
), c AS (
  SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1
), k AS (
  SELECT *, unnest(range(1, size)) AS cut FROM c
), s AS (
  SELECT k.lang, k.size, k.phrase, a, l.f AS l, r.f AS r, n, cut, (1000::HUGEINT * a * n // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM k JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(w[1:cut], ' ') JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(w[cut + 1:], ' ')
  JOIN n ON n.lang = k.lang
), b AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), o AS (
  SELECT lang, array_to_string(w[i:i + length - 1], ' ') AS phrase, max(a) AS over
  FROM (SELECT lang, w, a, length, unnest(range(1, size - length + 2)) AS i FROM c, range(2, 5) t(length) WHERE length < size) GROUP BY ALL
)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank, b.phrase, a, l, r, n, score
FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE over IS NULL OR 100 * over < 100 * a QUALIFY rank <= 2000
"""

ORACLE_SQL: dict[str, str] = {"op6_word_repeats": WORDS_SQL, "op3_knn": KNN_SQL, "op4_mixing": MIX_SQL, "op5_warc": WARC_SQL, "op8_exact_dedup": DEDUP_SQL}
ORACLE_SQL |= {"op11_conversations": CONVERSATIONS_SQL, "op12_decontaminate": DECONTAMINATE_SQL, "op13_collocations": COLLOCATIONS_SQL}
