"""The operators for training data as registered queries over whole tables, with SQL where it can say the same."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlog.catalog.query import Query
from cinderlog.llm import fixity, hostrules, lines, minhash, mixing, nearest, packing, quality, shuffling, simhash, spelling, tokens, turntrie

VOCABULARY = "byte_bpe_50k.json"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors of largest inner product for every 20th vector, against all."""
    return nearest.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def damaged(records: DataFrame) -> DataFrame:
    """A second copy of archived records with damage planted in its bytes by a hash of the page.

    One in 64 has its last byte changed. In every 16th file one in 16 each is cut to its first half, lost, or followed by
    one that does not belong there, so that everything behind it lies elsewhere.
    """
    dice = F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary"))
    shifting, kind, length = F.col("warc_file") % 16 == 0, F.substring(dice, 12, 1), F.length("record")
    found = (
        F.when(shifting & (kind == "0"), F.array(F.substring("record", F.lit(1), F.floor(length / 2).cast("int"))))
        .when(shifting & (kind == "1"), F.array().cast("array<string>"))
        .when(shifting & (kind == "2"), F.array("record", F.concat(F.lit("stray "), F.col("record"))))
        .when(F.substring(dice, 10, 2).isin("10", "20", "30", "40"), F.array(F.concat(F.substring("record", F.lit(1), length - 1), F.lit("~"))))
        .otherwise(F.array("record"))
    )
    return records.select("warc_file", "page_id", F.explode(found).alias("record"))


def op2_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as archived records against a second copy of the records with damaged, lost and stray ones."""
    records = fixity.archived(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return fixity.audit(fixity.laid_out(records), fixity.laid_out(damaged(records)))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity fingerprint and near-duplicate component of every document."""
    return simhash.simhash_groups(_documents(spark, sf_dir))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text."""
    return minhash.edit_likeness(_documents(spark, sf_dir))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak-label posterior, score and decision for every document."""
    scored = quality.classify(_documents(spark, sf_dir))
    return scored.select("doc_id", "votes", "posterior", "score", "keep")


def rated(labels: DataFrame) -> DataFrame:
    """Weights for drawing: 2 for documents labelled good, 0.5 for those labelled bad (where labels differ, bad)."""
    worst = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("worst"))
    return worst.select("doc_id", F.when(F.col("worst") >= 1, 2.0).otherwise(0.5).alias("quality"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words each document gives to a mix of all sources."""
    mixed = mixing.mix(_documents(spark, sf_dir), rated(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return tokens.token_counts(_documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the tokens of every document lie in sequences of 2048."""
    return packing.pack(_documents(spark, sf_dir), public_tokenizers.path(VOCABULARY)).drop("ids")


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every line of every document whether it is kept, and the earlier line it repeats."""
    return lines.line_decisions(_documents(spark, sf_dir)).drop("text_key")


def op10_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and place that every document was written to, read back from the shards."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return shuffling.shuffle_to_shards(_documents(spark, sf_dir)).select(
        "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct beginning of the rebuilt conversations."""
    return turntrie.turn_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts of every document and the verdict of its host (in these tables, its source)."""
    return hostrules.judge(_documents(spark, sf_dir), "source")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of seven letters or more with its near words and usual form."""
    return spelling.spelling_variants(_documents(spark, sf_dir))


FIXITY_SQL = """
WITH raw AS (
  SELECT page_id, md5(coalesce(CAST(page_id AS VARCHAR), '')) AS dice,
         concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: resource', chr(13), chr(10), 'WARC-Target-URI: ', coalesce(url, ''), chr(13), chr(10),
                'WARC-Record-ID: <urn:page:', coalesce(CAST(page_id AS VARCHAR), ''), '>', chr(13), chr(10), 'Content-Type: text/html', chr(13), chr(10),
                'Content-Length: ', CAST(strlen(coalesce(html, '')) AS VARCHAR), chr(13), chr(10), chr(13), chr(10), coalesce(html, ''),
                chr(13), chr(10), chr(13), chr(10)) AS record
  FROM pages),
files AS (SELECT greatest(256, CAST(ceil(sum(strlen(record)) / 67108864.0) AS BIGINT)) AS n FROM raw),
records AS (SELECT page_id, dice, record, CAST('0x' || substr(dice, 1, 8) AS BIGINT) % n AS warc_file FROM raw, files),
kinds AS (
  SELECT *, CASE WHEN warc_file % 16 = 0 AND substr(dice, 12, 1) = '0' THEN 'cut' WHEN warc_file % 16 = 0 AND substr(dice, 12, 1) = '1' THEN 'lost'
                 WHEN warc_file % 16 = 0 AND substr(dice, 12, 1) = '2' THEN 'followed' WHEN substr(dice, 10, 2) IN ('10', '20', '30', '40') THEN 'flipped'
                 ELSE 'sound' END AS kind FROM records),
copies AS (
  SELECT page_id, warc_file, CASE kind WHEN 'cut' THEN left(record, length(record) // 2) WHEN 'flipped' THEN left(record, length(record) - 1) || '~'
                                       ELSE record END AS record FROM kinds WHERE kind <> 'lost'
  UNION ALL SELECT page_id, warc_file, 'stray ' || record FROM kinds WHERE kind = 'followed'),
replicas AS (
  SELECT 1 AS side, page_id, warc_file, CAST(strlen(record) AS BIGINT) AS length, sha256(record) AS digest FROM records
  UNION ALL SELECT 2, page_id, warc_file, CAST(strlen(record) AS BIGINT), sha256(record) FROM copies),
placed AS (
  SELECT *, CAST(coalesce(sum(length) OVER (PARTITION BY side, warc_file ORDER BY page_id NULLS FIRST, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
  FROM replicas)
SELECT CAST(coalesce(a.warc_file, b.warc_file) AS INTEGER) AS warc_file, coalesce(a."offset", b."offset") AS "offset", a.length AS first_length, a.digest AS first_digest,
       b.length AS second_length, b.digest AS second_digest,
       CASE WHEN b.digest IS NULL THEN 'missing' WHEN a.digest IS NULL THEN 'extra' ELSE 'changed' END AS status
FROM (FROM placed WHERE side = 1) a FULL JOIN (FROM placed WHERE side = 2) b ON a.warc_file = b.warc_file AND a."offset" = b."offset"
WHERE a.digest IS DISTINCT FROM b.digest OR a.length IS DISTINCT FROM b.length
"""

MIXING_SQL = r"""
WITH rated AS (
  SELECT doc_id, CASE WHEN min(quality) >= 1 THEN 2.0 ELSE 0.5 END AS quality FROM labels
  WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
sized AS (
  SELECT d.doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         -ln((CAST('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
           / CAST(coalesce(quality, 1.0) AS DOUBLE) AS draw
  FROM documents d LEFT JOIN rated r ON d.doc_id = r.doc_id),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS turn FROM sized GROUP BY source),
weighed AS (SELECT *, 1 + (turn - 1) % 3 AS weight, CAST(sum(source_size) OVER () AS BIGINT) AS all_size FROM sources),
levels AS (
  SELECT *, CAST(all_size - coalesce(sum(3 * source_size) OVER (ORDER BY source_size / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(weight) OVER (ORDER BY source_size / weight, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM weighed),
judged AS (SELECT *, 3 * source_size <= level * weight AS is_full FROM levels),
goals AS (
  SELECT source, source_size, CASE WHEN is_full THEN CAST(3 * source_size AS DOUBLE) ELSE max(CASE WHEN NOT is_full THEN level END) OVER () * weight END AS target
  FROM judged),
line AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS through FROM sized),
parts AS (
  SELECT l.doc_id, l.size, l.through, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END AS epochs
  FROM line l JOIN goals g ON l.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (epochs + CASE WHEN target - epochs * source_size > 0 AND 2 * through - size <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM parts
"""

LINES_SQL = r"""
WITH texts AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
rows AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS line_no FROM texts),
worded AS (SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS words FROM rows),
said AS (SELECT *, len(words) AS n, CASE WHEN len(words) >= 1 THEN array_to_string(words, ' ') END AS line FROM worded),
firsts AS (SELECT line, min((doc_id, line_no)) AS place, any_value(words) AS words, any_value(n) AS n FROM said WHERE line IS NOT NULL GROUP BY line),
spread AS (
  SELECT line, place, n, i, array_to_string(words[1:i - 1] || words[i + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM firsts WHERE n >= 5)),
swapped AS (SELECT line, min(place) OVER (PARTITION BY n, i, rest) AS other, place FROM spread),
longer AS (SELECT s.line, s.place AS place, f.place AS other FROM spread s JOIN firsts f ON f.line = s.rest AND f.n >= 5),
links AS (
  SELECT line, other FROM swapped WHERE other < place
  UNION ALL SELECT line, other FROM longer WHERE other < place
  UNION ALL SELECT f.line, l.place FROM longer l JOIN firsts f ON f.place = l.other WHERE l.place < f.place),
near AS (SELECT line, min(other) AS keeper FROM links GROUP BY line),
judged AS (
  SELECT s.doc_id, s.line_no, CAST(s.n AS INTEGER) AS n_words, coalesce(r.keeper, f.place, (s.doc_id, s.line_no)) AS keeper
  FROM said s LEFT JOIN firsts f ON s.line = f.line LEFT JOIN near r ON s.line = r.line)
SELECT doc_id, line_no, n_words, keeper[1] = doc_id AND keeper[2] = line_no AS kept, keeper[1] AS keeper_doc_id, keeper[2] AS keeper_line_no FROM judged
"""

TRIE_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS id
  FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS place FROM said),
asked AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
         xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: ascii(c)::UBIGINT)),
           lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda bits, ignored: xor(bits >> 1, (bits & 1) * 3988292384))), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM said)),
parts AS (
  SELECT a.conv_id, 0 AS part, p.place, p.role, p.text FROM asked a JOIN placed p ON p.conv_id = a.base AND p.place <= a.h
  UNION ALL SELECT a.conv_id, 1, p.place, p.role, p.text FROM asked a JOIN placed p ON p.conv_id = a.conv_id AND p.place > a.h),
rebuilt AS (
  SELECT a.conv_id, coalesce(list({'role': role, 'text': text} ORDER BY part, place) FILTER (part IS NOT NULL), []) AS turns
  FROM asked a LEFT JOIN parts p USING (conv_id) GROUP BY a.conv_id),
members AS (SELECT conv_id, len(turns) AS n, unnest(range(len(turns) + 1)) AS depth, turns FROM rebuilt),
nodes AS (
  SELECT turns[1:depth] AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM members GROUP BY turns[1:depth], depth),
kids AS (SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
valued AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children, (n_convs - 1) * CASE WHEN n.depth > 0 THEN length(n.node[-1].text) ELSE 0 END AS value
  FROM nodes n LEFT JOIN kids k ON n.node = k.node),
up AS (SELECT *, unnest(range(depth + 1)) AS above FROM valued),
sums AS (
  SELECT node[1:above] AS node, CAST(sum(value) AS BIGINT) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM up GROUP BY ALL)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves, s.saved_tokens, v.ends_sha256
FROM valued v JOIN sums s ON v.node = s.node LEFT JOIN nodes p ON v.depth > 0 AND p.depth = v.depth - 1 AND p.node = v.node[1:v.depth - 1]
"""

HOST_RULES_SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
said AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM texts),
spread AS (SELECT rid, unnest(words) AS word, unnest(range(len(words))) AS place FROM said),
windows AS (
  SELECT rid, place, word, lead(word) OVER w AS second, lead(word, 2) OVER w AS third FROM spread WINDOW w AS (PARTITION BY rid ORDER BY place)),
counted AS (SELECT *, third IS NOT NULL AND count(*) OVER (PARTITION BY rid, word, second, third) > 1 AS twice FROM windows),
covered AS (
  SELECT rid, twice OR coalesce(lag(twice) OVER w, false) OR coalesce(lag(twice, 2) OVER w, false) AS again
  FROM counted WINDOW w AS (PARTITION BY rid ORDER BY place)),
repeats AS (SELECT rid, count(*) AS n_repeat_words FROM covered WHERE again GROUP BY rid),
lines AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM texts) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
counts AS (
  SELECT s.rid, doc_id, host, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[\x{0800}-\x{10FFFF}]')) AS BIGINT) AS n_wide,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(l.n_lines, 0) AS n_lines,
         coalesce(l.n_dup_lines, 0) AS n_dup_lines, coalesce(r.n_repeat_words, 0) AS n_repeat_words
  FROM said s LEFT JOIN lines l ON s.rid = l.rid LEFT JOIN repeats r ON s.rid = r.rid),
failures AS (
  SELECT doc_id, host, unnest(range(5)) AS rule, CAST(unnest([
    n_words < 50, 100 * n_repeat_words > 50 * n_words, 10 * n_symbols > n_words,
    word_chars < 3 * n_words OR (word_chars > 12 * n_words AND 2 * n_wide < word_chars), 10 * n_dup_lines > 3 * n_lines]) AS BIGINT) AS failed
  FROM counts),
hosts AS (SELECT host, rule, count(*) AS n, CAST(sum(failed) AS DOUBLE) AS f FROM failures GROUP BY host, rule),
moments AS (
  SELECT rule, count(*) AS hosts, CAST(sum(n) AS DOUBLE) AS docs, CAST(sum(n * n) AS DOUBLE) AS squares, sum(f) / CAST(sum(n) AS DOUBLE) AS mean, sum(f * f / n) AS spread
  FROM hosts GROUP BY rule),
strengths AS (
  SELECT rule, mean, 1 / least(greatest(
    CASE WHEN mean * (1 - mean) > 0 AND docs - squares / docs - (hosts - 1) > 0
         THEN ((spread - docs * mean * mean) / (mean * (1 - mean)) - (hosts - 1)) / (docs - squares / docs - (hosts - 1)) ELSE 0.001 END, 0.001), 0.5)::DOUBLE - 1 AS strength
  FROM moments),
verdicts AS (
  SELECT host, max(n) AS host_docs, max((f + mean * strength) / (n + strength)) AS rate FROM hosts JOIN strengths USING (rule) GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND rate <= 0.5 AS kept, c.host, host_docs, round(rate, 9) AS host_rate
FROM counts c JOIN verdicts v ON c.host IS NOT DISTINCT FROM v.host
"""

QUERIES = (
    Query("op1_nearest", op1_nearest),
    Query("op2_fixity", op2_fixity, FIXITY_SQL),
    Query("op3_simhash", op3_simhash),
    Query("op4_minhash", op4_minhash),
    Query("op5_quality", op5_quality),
    Query("op6_mixing", op6_mixing, MIXING_SQL),
    Query("op7_tokens", op7_tokens),
    Query("op8_packing", op8_packing),
    Query("op9_lines", op9_lines, LINES_SQL),
    Query("op10_shuffle", op10_shuffle),
    Query("op11_turn_trie", op11_turn_trie, TRIE_SQL),
    Query("op12_host_rules", op12_host_rules, HOST_RULES_SQL),
    Query("op13_spelling", op13_spelling),
    Query("pipeline", corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
)


def llm_queries() -> dict[str, Query]:
    return {query.name: query for query in QUERIES}
