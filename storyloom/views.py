"""Derived views over the supplied tables, in SQL that Spark and DuckDB both read ({table} marks a table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_NAME = "CASE (conv_id + CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END) % 6 WHEN 0 THEN 'Quinn' WHEN 1 THEN 'Layla' WHEN 2 THEN 'Vorden' WHEN 3 THEN 'Griff' WHEN 4 THEN 'Holt' ELSE 'Mara' END"
_TURNS = f"SELECT conv_id, turn, role, conv_id * 31 + turn * 17 + 3 AS k, replace(coalesce(text, ''), chr(10), ' ') AS text, {_NAME} AS name FROM {{conversations}}"

#: Paragraphs of a script, one per turn, of every kind that the span operators know.
PARAS = f"""
SELECT conv_id AS chapter_index, turn AS para_index, name, text AS said,
       CASE WHEN k % 7 = 0 THEN '***' WHEN k % 5 = 0 THEN '<User: ' || name || '>' WHEN k % 11 = 0 THEN 'Chapter ' || CAST(k AS STRING) || ': Start'
            WHEN k % 13 = 0 THEN 'Support us on Patreon' WHEN k % 19 = 0 THEN '[Quest Updated]' WHEN k % 17 = 0 THEN 'You gained <Skill> from ' || name || ' today.'
            WHEN k % 23 = 0 THEN chr(34) || 'Thanks, ' || name || '!' || chr(34) || ' Captain Holt replied.'
            WHEN k % 29 = 0 THEN chr(34) || text || chr(34) || ' the female  voice said.'
            WHEN k % 3 = 0 THEN chr(39) || text || chr(39) || ' ' || name || ' thought.'
            ELSE chr(34) || text || ',' || chr(34) || ' said ' || name || '.' END AS para
FROM ({_TURNS}) AS turns"""

_OTHER = _NAME.replace("conv_id + CASE", "conv_id + 2 + CASE")
#: Paragraphs with several cues, pronouns, phrases, names far off and open quotes, one per turn.
PROSE = f"""
SELECT conv_id AS chapter_index, turn AS para_index,
       CASE k % 9 WHEN 0 THEN other || ' said hello to the crowd and left. Then ' || name || ' said, ' || chr(34) || text || chr(34)
            WHEN 1 THEN chr(34) || text || ',' || chr(34) || ' ' || name || ' replied. He nodded. ' || chr(34) || 'Stop it!' || chr(34) || ' shouted ' || other || ' loudly.'
            WHEN 2 THEN name || ' came in. ' || chr(34) || text || chr(34) || ' he grumbled, and ' || other || ' laughed.'
            WHEN 3 THEN name || ' would, after all this, go on and on. ' || text || ' ' || chr(34) || 'Yes.' || chr(34)
            WHEN 4 THEN chr(34) || text || chr(34) || ' Nobody spoke. ' || text || ' Then Captain ' || other || ' quickly answered.'
            WHEN 5 THEN chr(39) || text || chr(39) || ' ' || name || ' had whispered. ' || chr(34) || 'No' || chr(34) || ' ' || chr(34) || 'Why?'
            WHEN 6 THEN text || ' ' || other || ' sighed! ' || chr(34) || text || chr(34) || ' and I said nothing.'
            WHEN 7 THEN chr(34) || 'Well.' || chr(34)
            ELSE 'They stood by ' || name || '. ' || chr(34) || text || chr(34) || ' She was saying it, asked ' || other || ' Holt? ' || chr(34) || 'Ha' || chr(34) END AS para
FROM (SELECT *, {_OTHER} AS other FROM ({_TURNS}) AS inner_turns) AS turns"""

_TYPE = "CASE k % 8 WHEN 0 THEN 'Narration' WHEN 1 THEN 'System' WHEN 5 THEN 'Thought' WHEN 7 THEN 'Heading' ELSE 'Dialogue' END"
#: Attributed spans, one per turn.
BASE = f"""
SELECT conv_id AS chapter_index, turn + 1 AS id, {_TYPE} AS type,
       CASE WHEN k % 6 = 0 THEN 'Unknown' WHEN k % 19 = 0 THEN NULL ELSE name END AS speaker,
       CASE k % 3 WHEN 0 THEN 'rule:surface_subj' WHEN 1 THEN 'rule:thought_cue' ELSE '' END AS method,
       CAST(50 + k % 50 AS DOUBLE) / 100 AS confidence, turn * 1000 AS start, turn * 1000 + length(text) AS finish, text
FROM ({_TURNS}) AS turns"""
#: The same spans after refinement: some unknown speakers found, some changed.
REFINED = f"""
SELECT conv_id AS chapter_index, turn + 1 AS id, {_TYPE} AS type,
       CASE WHEN k % 12 = 0 THEN name WHEN k % 6 = 0 THEN 'Unknown' WHEN k % 10 = 1 THEN 'Mara' WHEN k % 19 = 0 THEN NULL ELSE name END AS speaker,
       'llm' AS method, CAST(60 + k % 40 AS DOUBLE) / 100 AS confidence, turn * 1000 AS start, turn * 1000 + length(text) AS finish, text
FROM ({_TURNS}) AS turns"""
#: External quotes near the spans.
QUOTES = f"SELECT conv_id AS chapter_index, turn * 1000 + k % 90 - 20 AS q_start, turn * 1000 + k % 90 AS q_end, name AS quoted, CAST(k % 100 AS DOUBLE) / 100 AS prob FROM ({_TURNS}) AS turns WHERE k % 2 = 0"
#: Quotes of a second annotator, of the other turns.
QUOTES_AGAIN = f"SELECT conv_id AS chapter_index, turn * 1000 + k % 60 AS q_start, turn * 1000 + 200 AS q_end, name AS quoted, CAST(60 + k % 40 AS DOUBLE) / 100 AS prob FROM ({_TURNS}) AS turns WHERE k % 2 = 1"
#: Votes: a user's events of a day by type.
VOTES = "SELECT user_id, CAST(ts AS DATE) AS day, event_type AS candidate, count(*) AS votes FROM {events} GROUP BY user_id, CAST(ts AS DATE), event_type"
#: Books: a source's documents, whole, as chapters after a table of contents and a separator.
BOOKS = """
WITH d AS (SELECT source AS book, doc_id + 1 AS n, (SELECT max(doc_id) + 2 FROM {documents}) AS m,
                  'T' || CAST(doc_id AS STRING) || ' in ' || coalesce(lang, '') AS title, coalesce(text, '') AS body FROM {documents}),
b AS (SELECT DISTINCT book, 0 AS i, 'Table of Contents' AS text FROM d
      UNION ALL SELECT book, n AS i, 'Chapter ' || CAST(n AS STRING) || ': ' || title AS text FROM d
      UNION ALL SELECT DISTINCT book, m AS i, 'It was a dark and stormy night and nobody was there to see it but the owl.' AS text FROM d
      UNION ALL SELECT book, m + 2 * n AS i, 'Chapter ' || CAST(n AS STRING) || ': ' || title AS text FROM d
      UNION ALL SELECT book, m + 2 * n + 1 AS i, body AS text FROM d)
SELECT book, CAST(i AS BIGINT) AS index, text, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INT) AS line_count,
       CAST(length(text) - length(replace(text, ' ', '')) + 1 AS INT) AS word_count, CAST(length(text) AS INT) AS char_count FROM b"""
#: Chapters' quality: a month of orders each.
CHAPTER_QC = """
SELECT CAST(year(o_orderdate) AS STRING) AS book, CAST(month(o_orderdate) AS BIGINT) AS index, CAST(count(*) AS DOUBLE) / 7 AS duration_s,
       -15 - CAST(count(*) % 11 AS DOUBLE) AS lufs, -1 - CAST(count(*) % 5 AS DOUBLE) AS peak, -55 - CAST(count(*) % 10 AS DOUBLE) AS noise
FROM {orders} GROUP BY year(o_orderdate), month(o_orderdate)"""
#: Lines of device monitors, a log for each priority of orders: two tables' headers, which take turns, ends and rows.
MONITOR_LINES = """
SELECT o_orderpriority AS log, o_orderkey AS line_no,
       CASE WHEN o_custkey % 40 = 0 THEN 'Device r/s w/s rMB/s wMB/s %util' WHEN o_custkey % 40 = 1 THEN 'Device: %util  w/s r/s' WHEN o_custkey % 40 = 2 THEN ''
            ELSE '  sd' || CAST(o_custkey % 3 AS STRING) || '  ' || CAST(o_orderkey % 7 AS STRING) || '.5 ' || CAST(o_orderkey % 11 AS STRING) || '   ' || CAST(o_custkey % 13 AS STRING) || CASE WHEN o_custkey % 5 = 0 THEN '' ELSE ' 1.25 ' || CAST(o_custkey % 100 AS STRING) || '%' END END AS line
FROM {orders}"""
#: Names with edits, and the names they come from.
MENTIONS = """
SELECT CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN 'I ' || c_name WHEN 2 THEN replace(c_name, '0', '') ELSE c_name || 'x' END AS mention FROM {customer}"""
CANONICAL = "SELECT s_name AS canonical, s_suppkey AS rank FROM {supplier} UNION ALL SELECT c_name AS canonical, c_custkey + 1000000 AS rank FROM {customer} WHERE c_custkey % 3 = 0"
PROFILES = "SELECT * FROM (VALUES (1, 'Quinn', 'piper', 'v1'), (2, 'Layla', 'piper', 'v2'), (3, 'Narrator', 'xtts', 'x1'), (4, 'Griff', 'piper', 'gone')) AS t(rank, profile, engine, voice)"
ALIASES = "SELECT * FROM (VALUES ('the  Ghoul', 'Quinn'), ('vorden', 'Layla'), ('LAYLA', 'Quinn'), ('vorden', 'Griff')) AS t(alias, profile)"
VOICES = "SELECT * FROM (VALUES ('piper', 'v1'), ('piper', 'v2'), ('xtts', 'x1')) AS t(engine, voice)"
FALLBACK = "SELECT * FROM (VALUES ('piper', 'v1'), ('xtts', 'x1')) AS t(engine, voice)"
#: Voice profiles of suppliers, aliases that customers' names give, and registered voices.
SUPPLIER_PROFILES = "SELECT s_suppkey AS rank, s_name AS profile, 'engine' || CAST(s_nationkey % 5 AS STRING) AS engine, 'v' || CAST(s_suppkey % 7 AS STRING) AS voice FROM {supplier}"
CUSTOMER_ALIASES = """
SELECT CASE c_custkey % 3 WHEN 0 THEN replace(c_name, 'Customer', ' SUPPLIER ') WHEN 1 THEN replace(c_name, 'Customer', 'Supplier') ELSE c_mktsegment || ' ' || CAST(c_custkey % 50 AS STRING) END AS alias, s_name AS profile
FROM {customer} JOIN {supplier} ON s_nationkey = c_nationkey AND s_suppkey % 4 = c_custkey % 4"""
SUPPLIER_VOICES = "SELECT DISTINCT 'engine' || CAST(s_nationkey % 4 AS STRING) AS engine, 'v' || CAST(s_suppkey % 6 AS STRING) AS voice FROM {supplier} WHERE s_suppkey % 3 > 0"

TABLES = ("conversations", "events", "documents", "orders", "customer", "supplier")


def view(spark: SparkSession, sf_dir: str, sql: str, **given: DataFrame) -> DataFrame:
    """A view over the tables of a folder, or those given."""
    used = {t: given[t] if t in given else spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in sql}
    return spark.sql(sql, **used)


def duck(sql: str) -> str:
    """A view's text for DuckDB."""
    for t in TABLES:
        sql = sql.replace(f"{{{t}}}", t)
    return f"({sql})"
