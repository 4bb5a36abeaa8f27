"""The registered queries of this subpackage: opN_<name>(spark, sf_dir), over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm import bpe, chat, codes, decontaminate, jaccard, langid, lm, neighbours, quality, sharding, sstable, tries, urls

#: The rules of op7.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Where a vocabulary file of the public tokenizers lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_multi_50k.tiktoken"))


def op3_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(_table(spark, sf_dir, "embeddings"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents")).drop("text_hash")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.match(_table(spark, sf_dir, "pages"), urls.rules_table(spark, URL_RULES))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "spans",
    )


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(chat.planted(spark))
    path = tokenizer("byte_bpe_50k.tiktoken")
    return chat.read_back(chat.format_turns(turns, path), path).drop("n_ids")


def op10_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.read(sstable.write(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json")))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.trie(_table(spark, sf_dir, "conversations"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_sharding, op2_byte_bpe, op3_suffix_tree, op4_neighbours, op5_jaccard, op6_quality, op7_url_filters, op8_decontamination, op9_chat, op10_sstable, op11_prefix_trie, op12_language_id, op13_vector_codes)
}



def _codes_sql(rounds: int = codes.ROUNDS) -> str:
    """Vector codes in DuckDB: one pair of common tables a round."""
    steps = [rf"""
WITH k AS (SELECT row_number() OVER () AS row, vec_id, label, embedding FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT row, vec_id, label, p, list_transform(embedding[p * 8 + 1 : p * 8 + 8], lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS x FROM k, range(8) AS r(p)),
c0 AS (SELECT p, e - 1 AS e, x FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) AS e FROM q) WHERE e <= 16)"""]
    for n in range(rounds + 1):
        steps.append(rf"""
d{n} AS (SELECT row, p, min(struct_pack(d := d, e := e)) AS best FROM (
            SELECT row, q.p AS p, e, list_sum(list_transform(range(1, 9), lambda i: (q.x[i] - c.x[i]) * (q.x[i] - c.x[i])))::BIGINT AS d FROM q JOIN c{n} AS c ON c.p = q.p) GROUP BY row, p)""")
        if n < rounds:
            steps.append(rf"""
m{n} AS (SELECT p, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM (
            SELECT q.p AS p, best.e AS e, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM q JOIN d{n} AS d ON d.row = q.row AND d.p = q.p, range(1, 9) AS r(i) GROUP BY q.p, best.e, i) GROUP BY p, e),
c{n + 1} AS (SELECT c.p, c.e, coalesce(m.x, c.x) AS x FROM c{n} AS c LEFT JOIN m{n} AS m ON m.p = c.p AND m.e = c.e)""")
    last = rf"""
coded AS (SELECT row, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM d{rounds} GROUP BY row)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM c{rounds}) AS codebooks_sha256
FROM k JOIN coded USING (row)"""
    return ",".join([*steps, last])


ORACLE_SQL: dict[str, str] = {
    "op7_url_filters": r"""
WITH u AS (
    SELECT page_id,
           CASE WHEN position('://' IN url) > 0 THEN translate(regexp_extract(substr(url, position('://' IN url) + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
           CASE WHEN position('://' IN url) > 0 THEN regexp_extract(substr(url, position('://' IN url) + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
    FROM pages),
r(rule, action, rule_host, rule_path) AS (VALUES ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'), ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/'))
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path,
       arg_max(rule, length(rule)) AS rule, coalesce(arg_max(action, length(rule)), 'allow') AS verdict
FROM u LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
GROUP BY page_id, host, path""",
    "op9_chat": r"""
WITH t AS (
    SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (
    SELECT *, coalesce(role, '') AS r, coalesce(role, '') || text AS x,
           '<(?:\|(?:turn|content|end|im_start|im_end|endoftext|system|user|assistant)\|>|/?s>|</?SYS>>)|\[/?INST\]' AS control FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(r || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(26 + length(x) + length(x) - length(replace(x, '\', '')) + len(regexp_extract_all(r, control)) + len(regexp_extract_all(text, control)))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
    "op11_prefix_trie": r"""
WITH t AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS i, digest, words
    FROM (SELECT conv_id, turn, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS digest,
                 len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL)),
c AS (
    SELECT conv_id, conv_id - conv_id % 20 AS donor,
           xor(list_reduce(flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x), 0, 0, 0, 0, 0, 0, 0]::BIGINT[])),
               lambda crc, x: xor(xor(crc, x) >> 1, 3988292384 * (xor(crc, x) & 1)), 4294967295::BIGINT), 4294967295::BIGINT) % 4 AS h
    FROM (SELECT DISTINCT conv_id FROM t)),
k AS (SELECT c.conv_id, donor, h, least(h, count(t.i)) AS k FROM c LEFT JOIN t ON t.conv_id = donor GROUP BY c.conv_id, donor, h),
r AS (
    SELECT k.conv_id, i AS d, digest, words FROM k JOIN t ON t.conv_id = donor AND i <= h
    UNION ALL SELECT k.conv_id, k.k + i - h AS d, digest, words FROM k JOIN t ON t.conv_id = k.conv_id AND i > h),
p AS (
    SELECT conv_id, d, words, md5(string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY d)) AS key FROM r
    UNION ALL SELECT conv_id, 0, 0, 'root' FROM c),
n AS (SELECT d, key, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM p GROUP BY d, key),
up AS (SELECT n.*, b.key AS parent, a.conv_id AS parent_conv_id FROM n LEFT JOIN p AS b ON b.conv_id = n.conv_id AND b.d = n.d - 1 LEFT JOIN n AS a ON a.d = b.d AND a.key = b.key),
kids AS (SELECT parent, d - 1 AS d, count(*) AS n_children FROM up WHERE d > 0 GROUP BY parent, d),
whole AS (SELECT up.*, coalesce(n_children, 0) AS n_children FROM up LEFT JOIN kids ON kids.parent = up.key AND kids.d = up.d),
below AS (
    SELECT a.d, a.key, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * w.words) AS saved_tokens
    FROM whole AS w JOIN p AS a ON a.conv_id = w.conv_id AND a.d <= w.d GROUP BY a.d, a.key),
ends AS (
    SELECT key, d, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
    FROM (SELECT *, max(d) OVER (PARTITION BY conv_id) AS last FROM p) WHERE d = last GROUP BY key, d)
SELECT w.conv_id, w.d::BIGINT AS depth, w.parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM whole AS w JOIN below AS b ON b.d = w.d AND b.key = w.key LEFT JOIN ends AS e ON e.d = w.d AND e.key = w.key""",
    "op13_vector_codes": _codes_sql(),
}
