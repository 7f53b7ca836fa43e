"""The vault-shaped corpus that the queries derive from the documents table: one SQL text for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NOTES_SQL = """
WITH d AS (SELECT doc_id, text, lang, source, n_chars, (SELECT COUNT(*) FROM {documents}) AS n FROM {documents})
SELECT
  CASE WHEN doc_id % 10 = 0 THEN 'Inbox/'
       WHEN doc_id % 10 <= 3 THEN 'Projects/P' || CAST(doc_id % 7 AS STRING) || '/'
       WHEN doc_id % 10 <= 6 THEN 'Areas/' || lang || '/' || source || '/'
       WHEN doc_id % 10 <= 8 THEN 'Resources/' || source || '/' || lang || '/'
       ELSE 'Archive/' END
    || CASE WHEN doc_id % 11 = 0 THEN 'n' || CAST(doc_id + 1 AS STRING)
            WHEN doc_id % 10 = 1 AND doc_id % 3 = 0 AND doc_id >= 70 THEN 'n' || CAST(doc_id - 70 AS STRING) || ' copy'
            ELSE 'n' || CAST(doc_id AS STRING) END || '.md' AS path,
  CASE WHEN n_chars % 5 = 0 THEN '---' || chr(10) || 'note_role: source' || chr(10) || 'tags: [' || lang || ', load/' || CAST(n_chars % 4 AS STRING) || ']' || chr(10) || '---' || chr(10)
       WHEN n_chars % 5 = 1 THEN '---' || chr(10) || 'note_role: umbrella' || chr(10) || '---' || chr(10)
       WHEN n_chars % 5 = 2 THEN '---' || chr(10) || 'note_role: summary' || chr(10) || '---' || chr(10)
       ELSE '' END
    || '# ' || substr(text, 1, 24) || chr(10) || chr(10)
    || CASE WHEN n_chars % 9 = 4
            THEN '- [[n' || CAST(n_chars % n AS STRING) || ']]' || chr(10) || '[[n' || CAST((n_chars * 3) % n AS STRING) || ']]' || chr(10)
            ELSE text || chr(10) || chr(10)
              || '## Links' || chr(10) || chr(10)
              || '- [[n' || CAST(n_chars % n AS STRING) || ']] and [[n' || CAST((n_chars * 7) % (2 * n) AS STRING) || '|alias]]' || chr(10)
              || '- [' || CASE WHEN n_chars % 3 = 0 THEN 'x' ELSE ' ' END || '] review #' || lang || '/' || CAST(n_chars % 6 AS STRING) || chr(10)
              || '```' || chr(10) || '# not a heading [[nope]]' || chr(10) || '```' || chr(10) END AS text,
  CAST(doc_id AS DOUBLE) AS mtime, doc_id
FROM d
"""


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, text, mtime, doc_id."""
    return spark.sql(NOTES_SQL.format(documents="{documents}"), documents=spark.read.parquet(f"{sf_dir}/documents.parquet"))
