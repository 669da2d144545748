"""One query per operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import byte_bpe, chat, extraction, language, minhash, mixing, multi_index, norm_buckets, prefix_trie, repeats, toxicity, weighted_prints
from riskloom.llm.exact_dedup import exact_dedup
from riskloom.llm.folds import remainder
from riskloom.llm.registry import QUERIES, query


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
""")
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


@query()
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    tokens = byte_bpe.encode(read(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN)
    return byte_bpe.decode(tokens, vocabulary).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query()
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 5) == 0
    model = language.fit(docs, ~held_out)
    return language.identify(docs, model).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


@query()
def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), percent=85)


@query()
def op6_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), repetition=1.2)


@query()
def op10_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(read(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


#: A conversation made of the template's own marks.
MARKS = r"\### Assistant: </turn> ok"


@query(rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{MARKS}'), (-7, 1, 'assistant', '{MARKS}')
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), ''))
         AS loss_sha256,
       CAST(sum(15 + length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g'))
                + length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
""")
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = spark.createDataFrame([(-7, 0, "user", MARKS), (-7, 1, "assistant", MARKS)], turns.schema)
    back = chat.read_back(chat.format_conversations(turns.union(marks)))
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query()
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = read(spark, sf_dir, "documents"), remainder("doc_id", 3) == 1
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted"
    )


@query()
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extraction.extract(read(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query()
def op3_run_length_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(read(spark, sf_dir, "documents"))


@query()
def op13_weighted_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_prints.fingerprints(read(spark, sf_dir, "documents"))


@query(r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents
), s AS (
  SELECT count(*) FILTER (len(t) > 0) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), f AS (
  SELECT doc_id, r, n, term, count(*) AS tf
  FROM (SELECT doc_id, r, len(t) AS n, unnest(t) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
  FROM f, s GROUP BY term
), scored AS (
  SELECT item_id, doc_id, r,
         CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN f USING (term), s GROUP BY item_id, doc_id, r
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
       doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50
""")
def op12_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm_buckets.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query(r"""
WITH t AS (
  SELECT conv_id AS c, list({'role': coalesce(role, ''), 'text': coalesce(text, '')}
                            ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), crc AS (
  SELECT list(value ORDER BY i) AS steps FROM (
    SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
                          lambda v, bit: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END) AS value
    FROM (SELECT unnest(range(256)) AS i))
), h AS (
  SELECT c, turns, c - c % 20 AS base, xor(list_reduce(
           list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
           lambda v, x: xor(v // 256, steps[xor(v, x) % 256 + 1])), 4294967295) % 4 AS taken
  FROM t, crc
), r AS (
  SELECT h.c, list_concat(coalesce(b.turns, [])[1:h.taken], h.turns[h.taken + 1:]) AS turns
  FROM h LEFT JOIN t AS b ON b.c = h.base
), p AS (
  SELECT c, unnest(range(len(turns) + 1)) AS depth, turns FROM r
), n AS (
  SELECT depth, turns[1:depth] AS prefix, min(c) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(turns) = depth), '')) AS ends_sha256
  FROM p GROUP BY ALL
), m AS (
  SELECT n.*, up.conv_id AS parent_conv_id,
         (n.n_convs - 1) * CASE WHEN n.depth = 0 THEN 0
           ELSE len(regexp_extract_all(n.prefix[n.depth].text, '[^\x20\x09-\x0D]+')) END AS saved
  FROM n LEFT JOIN n AS up ON up.depth = n.depth - 1 AND up.prefix = n.prefix[1:n.depth - 1]
), k AS (
  SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM m WHERE depth > 0 GROUP BY ALL
), s AS (
  SELECT above.depth, above.prefix, sum(x.saved) AS saved_tokens, count(*) FILTER (x.n_children IS NULL) AS n_leaves
  FROM (SELECT m.*, k.n_children, unnest(range(m.depth + 1)) AS at FROM m LEFT JOIN k USING (conv_id, depth)) AS x
  JOIN n AS above ON above.depth = x.at AND above.prefix = x.prefix[1:x.at] GROUP BY ALL
)
SELECT m.conv_id, m.depth, m.parent_conv_id, m.n_convs, coalesce(k.n_children, 0) AS n_children,
       CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m JOIN s USING (depth, prefix) LEFT JOIN k ON k.conv_id = m.conv_id AND k.depth = m.depth
""")
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read(spark, sf_dir, "conversations"))
