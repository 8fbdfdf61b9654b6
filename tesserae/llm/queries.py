"""The registered queries ``opN_<name>`` over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import chat, hard_negatives, idfile, lattice, mixing, ngram_join, packing, pieces, quality, resampling, secret_scan, tokencount, warc
from tesserae.llm._common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"))


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = idfile.write_ids(table(spark, sf_dir, "documents"))
    return idfile.read_ids(spark, folder, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    rows = plan.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.size("draws") * F.col("size")).cast("long").alias("taken"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(table(spark, sf_dir, "embeddings"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(table(spark, sf_dir, "documents")).drop("reported", "text_hash")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")), with_data=False).where("last")
    digest = F.when(F.col("record_type") == "response", F.col("digest_so_far")).otherwise(F.col("header_digest"))
    return rows.select(F.col("id").alias("page_id"), "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.element_at(F.array(F.lit("user"), F.lit("assistant")), F.col("id").cast("int") + 1).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    back = chat.read_chats(chat.format_chats(turns.unionByName(planted)))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.importance_ranks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode_pieces(table(spark, sf_dir, "documents"))
    spanned = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, n: s + n)
    read = pieces.decode_pieces(coded.select("doc_id", "n_tokens", "ids", spanned.alias("spanned_bytes")))
    return read.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "spanned_bytes")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_rules, op2_token_counts, op3_token_ids, op4_source_mix, op5_embedding_dedup, op6_ngram_jaccard, op7_secret_scan, op8_warc, op9_packing, op10_chat_formatting, op11_importance_resampling, op12_sentencepiece, op13_hard_negatives)}

#: Quality rules in SQL: the measures by word lists and 8-word windows, the verdict as one condition.
OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS k FROM documents
), w AS (
  SELECT k, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d
), lines AS (
  SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k
), wins AS (
  SELECT k, i, array_to_string(words[i:i+7], ' ') AS win
  FROM (SELECT k, words, unnest(range(1, greatest(len(words) - 6, 1))) AS i FROM w)
), twice AS (
  SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, win) AS n FROM wins) WHERE n > 1
), reps AS (
  SELECT k, count(DISTINCT i + j) AS n_repeat_words FROM twice, range(8) t(j) GROUP BY k
), m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines,
    len(list_filter(words, lambda x: ends_with(x, '!!'))) AS n_shouts,
    len(list_filter(words, lambda x: regexp_full_match(x, '[!-/:-@\[-`{-~]+'))) AS n_bare
  FROM w LEFT JOIN lines USING (k) LEFT JOIN reps USING (k)
), b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (10 * n_symbols > 3 * n_words OR 100 * n_dup_lines > 60 * n_lines
    OR 100 * n_shouts > 30 * n_words OR 100 * n_bare > 40 * n_words) AS kept
FROM b
"""

#: Chat formatting in SQL. Escaping is reversible, so the digests read back are those of the rows themselves.
OP10_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(regexp_replace(replace(text, '\', '\\'), '<(\|im_start\|>|\|im_end\|>|\|endoftext\|>|<SYS>>|</SYS>>|s>|/s>)|\[(INST\]|/INST\])', '..\1\2', 'g')) AS n FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(12 + coalesce(length(role), 2) + 1 + n + 10)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

#: Shingle sets, all pairs by shared shingles, and the smallest reachable id by a recursive walk.
OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i+4], ' ') AS sh
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM w
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(b) FROM reach r WHERE r.a = w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id)
"""

#: Payloads and their digests; of equal ones of 1000 bytes or more the largest page is the response.
OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p
), m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM d JOIN m USING (page_id, payload_bytes, payload_digest)
"""

#: All pairs of usable vectors by their cosine, and the smallest reachable id by a recursive walk.
#: The lattice may miss a pair near the threshold; rows agree where it misses none.
OP5_SQL = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.9
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), n AS (SELECT a AS vec_id, count(*)::BIGINT AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM least LEFT JOIN n USING (vec_id)
"""

#: Resampling in SQL. The crc32 of a word runs over its bytes with the table of the reflected polynomial 0xEDB88320.
OP11_SQL = r"""
WITH RECURSIVE crc_table(k, c, step) AS (
  SELECT k::BIGINT, k::BIGINT, 0 FROM range(256) t(k)
  UNION ALL SELECT k, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM crc_table WHERE step < 8
), crc AS MATERIALIZED (SELECT list(c ORDER BY k) AS tab FROM crc_table WHERE step = 8
), texts AS (
  SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark
), words AS MATERIALIZED (
  SELECT side, id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM texts
), hexes AS (SELECT w, hex(w) AS h FROM (SELECT DISTINCT w FROM words)
), codes AS (
  SELECT w, list_prepend(4294967295::BIGINT, list_transform(range(0, len(h) // 2), lambda i: (strpos('0123456789ABCDEF', h[2*i+1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2*i+2]) - 1)) AS b FROM hexes
), buckets AS MATERIALIZED (
  SELECT w, xor(list_reduce(b, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM codes, crc
), found AS MATERIALIZED (SELECT side, id, bucket FROM words JOIN buckets USING (w)
), n AS (SELECT count(*) FILTER (WHERE side = 0)::DOUBLE AS s, count(*) FILTER (WHERE side = 1)::DOUBLE AS t FROM found
), own AS (SELECT bucket, count(*) FILTER (WHERE side = 0)::DOUBLE AS x, count(*) FILTER (WHERE side = 1)::DOUBLE AS y FROM found GROUP BY bucket
), gains AS (SELECT bucket, floor(1000.0 * ln((y + 1.0) * (n.s + 10000.0) / ((x + 1.0) * (n.t + 10000.0))))::BIGINT AS gain FROM own, n
), sums AS (SELECT id AS doc_id, count(*) AS n_features, sum(gain) AS total FROM found JOIN gains USING (bucket) WHERE side = 0 GROUP BY id
), scored AS (
  SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(floor(total / n_features), 0)::BIGINT AS weight,
    floor(-1000.0 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296.0)))::BIGINT AS noise
  FROM documents LEFT JOIN sums USING (doc_id)
), ranks AS (SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM scored LEFT JOIN ranks USING (doc_id)
"""

#: All products of anchors and rows, best five of the own label, then the best three in each window.
OP13_SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 3
"""

ORACLE_SQL: dict[str, str] = {"op1_quality_rules": OP1_SQL, "op5_embedding_dedup": OP5_SQL, "op6_ngram_jaccard": OP6_SQL, "op8_warc": OP8_SQL, "op10_chat_formatting": OP10_SQL, "op11_importance_resampling": OP11_SQL, "op13_hard_negatives": OP13_SQL}
