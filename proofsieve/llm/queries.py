"""The queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofsieve.llm import bpe, chat, collocations, decontam, negatives, ngram, pii, planes, rules, shards, simhash, toxic, wrapper


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(_table(spark, sf_dir, "documents"))


def op3_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    lexicon = bpe.build_lexicon(docs, public_tokenizers.path("word_bpe_49k.json"))
    return bpe.digests(bpe.round_trip(docs, lexicon))


def op4_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.main_text(_table(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(_table(spark, sf_dir, "documents")).drop("char_distance", "word_distance")


def op6_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(_table(spark, sf_dir, "documents"))


def op7_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


def op8_edit_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_toxic_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op11_count_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_bit_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return negatives.mine(rows.select("vec_id", moved.alias("label"), negatives.quantised(F.col("embedding")).alias("v")), F.col("vec_id") % 100 == 0)


def op13_plane_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = planes.stored(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return stored.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_kneser_ney, op2_simhash_anchors, op3_bpe_lexicon, op4_html_wrappers, op5_quality_rules, op6_label_propagation, op7_role_repair, op8_edit_matching, op9_toxic_cnn, op10_disclosure, op11_count_min, op12_bit_sliced, op13_plane_files)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op5_quality_rules": OP5_SQL, "op11_count_min": OP11_SQL, "op12_bit_sliced": OP12_SQL}


#: Words, windows and histograms spelt out in SQL; the distances use the same reference.
OP5_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS lang FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
tokens AS (SELECT r, lang, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
windows AS (SELECT r, unnest(list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i + 7], ' '))) AS win,
    unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, win) > 1 AS again FROM windows),
covered AS (SELECT tokens.r, max(CASE WHEN again THEN 1 ELSE 0 END) OVER (PARTITION BY tokens.r ORDER BY tokens.i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS hit
    FROM tokens LEFT JOIN twice ON tokens.r = twice.r AND tokens.i = twice.i),
repeated AS (SELECT r, sum(hit) AS n FROM covered GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT x) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d)
    WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY r),
base AS (SELECT w.r, doc_id, lang, t, len(ws) AS n_words, coalesce(length(array_to_string(ws, '')), 0) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words
    FROM w LEFT JOIN lines ON w.r = lines.r LEFT JOIN repeated ON w.r = repeated.r),
classes AS (SELECT r, lang, unnest(range(0, 8)) AS bin, unnest([
    length(t) - length(regexp_replace(t, '[a-z]', '', 'g')), length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')),
    length(t) - length(regexp_replace(t, '[0-9]', '', 'g')), length(t) - length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')),
    length(t) - length(regexp_replace(t, '[.,;:!?''"()-]', '', 'g')), length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')),
    length(regexp_replace(t, '[a-zA-Z0-9\\x20\\x09-\\x0D.,;:!?''"()#*$%&|<>-]|[^\\x00-\\x7F]', '', 'g')), length(t) - length(regexp_replace(t, '[^\\x00-\\x7F]', '', 'g'))]) AS n FROM d),
class_ref AS (SELECT lang, bin, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM classes GROUP BY lang, bin),
common AS (SELECT lang, word, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, encode(word)) AS k FROM tokens GROUP BY lang, word),
word_ref AS (SELECT lang, least(k, 201) AS bin, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM common GROUP BY lang, least(k, 201)),
word_bins AS (SELECT tokens.r, tokens.lang, least(k, 201) AS bin, count(*) AS n FROM tokens JOIN common ON tokens.lang = common.lang AND tokens.word = common.word GROUP BY ALL),
hist AS (SELECT 'c' AS kind, c.r, n / sum(n) OVER (PARTITION BY c.r) AS p, q FROM classes c JOIN class_ref f ON c.lang = f.lang AND c.bin = f.bin WHERE n > 0
    UNION ALL SELECT 'w', b.r, n / sum(n) OVER (PARTITION BY b.r), q FROM word_bins b JOIN word_ref f ON b.lang = f.lang AND b.bin = f.bin),
js AS (SELECT r, kind, sqrt(greatest(0, (sum(p * log2(2 * p / (p + q)) - q + q * log2(2 * q / (p + q))) + 1) / 2)) AS x FROM hist GROUP BY r, kind),
judged AS (SELECT base.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, CASE WHEN length(t) >= 200 THEN c.x ELSE 0 END AS by_char, CASE WHEN n_words >= 100 THEN v.x ELSE 0 END AS by_word
    FROM base LEFT JOIN js c ON base.r = c.r AND c.kind = 'c' LEFT JOIN js v ON base.r = v.r AND v.kind = 'w')
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
    n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND by_char <= 0.26 AND by_word <= 0.56 AS kept FROM judged
"""

#: All phrases counted, without a sketch.
OP11_SQL = """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS ws FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM d)),
total AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM pieces GROUP BY lang),
f AS (SELECT lang, m, phrase, count(*) AS a FROM (SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase
    FROM pieces, (VALUES (1), (2), (3), (4), (5)) t(m) WHERE len(ws) >= m) GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE m >= 2),
cuts AS (SELECT lang, phrase, m, a, k, array_to_string(ws[1:k], ' ') AS x, array_to_string(ws[k + 1:m], ' ') AS y FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
rated AS (SELECT cuts.lang, cuts.phrase, cuts.m, cuts.a, k, l.a AS l, r.a AS r, n, ((1000::HUGEINT * cuts.a * n) // (l.a::HUGEINT * r.a))::BIGINT AS score
    FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = x JOIN f r ON r.lang = cuts.lang AND r.phrase = y JOIN total ON total.lang = cuts.lang),
lowest AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
around AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest(flatten(list_transform(range(2, m), lambda w: list_transform(range(1, m - w + 2), lambda i: array_to_string(ws[i:i + w - 1], ' '))))) AS phrase FROM c WHERE m >= 3) GROUP BY ALL),
kept AS (SELECT lowest.*, row_number() OVER (PARTITION BY lowest.lang ORDER BY score DESC, a DESC, encode(lowest.phrase)) AS rank
    FROM lowest LEFT JOIN around ON around.lang = lowest.lang AND around.phrase = lowest.phrase WHERE longer IS NULL OR 100 * longer < 100 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM kept WHERE rank <= 2000
"""

#: Every product spelt out.
OP12_SQL = """
WITH v AS (SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.k AS anchor, a.vec_id AS anchor_id, b.k, b.vec_id, a.label = b.label AS same, coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda z: coalesce(z[1] * z[2], 0))), 0)::BIGINT AS score
    FROM v a JOIN v b ON a.k <> b.k WHERE a.vec_id % 100 = 0),
positive AS (SELECT anchor, anchor_id, k, vec_id AS positive_id, score AS p FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST) <= 5),
ranked AS (SELECT t.anchor_id, positive_id, n.vec_id AS negative_id, p AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY t.anchor, t.k ORDER BY n.score DESC, n.vec_id NULLS LAST) AS rank
    FROM positive t JOIN pairs n ON n.anchor = t.anchor AND NOT n.same AND 30 * p <= 100 * n.score AND 100 * n.score <= 90 * p)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""
