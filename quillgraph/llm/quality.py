"""Host-level quality rules, in DataFrame expressions alone.

Each document is judged by rules of its own. Failures are then counted by host, each host's failure
rate is shrunk towards a beta prior fitted to all hosts, and a host whose shrunk rate is beyond the
threshold with confidence is rejected as a whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import SPACE_CLASS, let, materialize, words

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"


#: Rejected hosts (a DNS name has 253 characters at most) that are broadcast, at most.
BROADCAST_HOSTS = 100_000


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: A host is rejected when its shrunk failure rate, less `deviations` posterior standard deviations, is above this.
    max_host_rate: float = 0.5
    deviations: float = 2.0
    #: Bounds of the prior's weight in documents, for hosts that hardly differ or differ extremely.
    least_weight: float = 2.0
    most_weight: float = 1000.0


def repeated_words(ws: Column) -> Column:
    """How many words stand in a 3-word window that is found twice or more. Windows are compared by
    64-bit hash within the document: they are sorted with their positions, those equal to a neighbour
    are kept, and the positions they cover are summed, all in O(n log n)."""

    def covered(windows: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(windows, i)["h"] == x["h"], F.lit(False))
        again = F.filter(windows, lambda x, i: same(x, i - 1) | same(x, i + 1))
        places = F.array_sort(F.transform(again, lambda x: x["i"]))
        return F.aggregate(
            places,
            F.struct(F.lit(-9).alias("last"), F.lit(0).cast("long").alias("n")),
            lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")),
            lambda acc: acc["n"],
        )

    def hashed(w: Column) -> Column:
        starts = F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))
        return F.array_sort(F.transform(starts, lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))))

    return F.when(F.size(ws) < 4, F.lit(0).cast("long")).otherwise(let(hashed(ws), covered))


def document_facts(docs: DataFrame, rules: QualityRules = QualityRules(), text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.
    A null or blank text has no words, so it fails. Columns of these names are replaced."""
    t = F.coalesce(F.col(text), F.lit(""))
    with_word = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    facts = let(
        words(F.col(text)),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )
    lines = let(with_word, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    return (
        docs.withColumn("_facts", facts)
        .withColumns(
            {
                "n_words": F.col("_facts.n_words"),
                "word_chars": F.col("_facts.word_chars"),
                "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
                "n_dup_lines": lines,
                "n_repeat_words": F.col("_facts.n_repeat_words"),
            }
        )
        .withColumn(
            "base_failed",
            (F.col("n_words") < rules.min_words) | (F.lit(100) * F.col("n_repeat_words") > F.lit(rules.max_repeat_percent) * F.col("n_words")),
        )
        .drop("_facts")
    )


def host_verdicts(facts: DataFrame, host: str, rules: QualityRules = QualityRules()) -> DataFrame:
    """One row for each host: host, n_docs, n_failed, shrunk_rate, host_rejected. The prior's mean is
    the corpus rate, its weight comes from the variance of the hosts' rates (method of moments), so a
    host with few documents stays close to the corpus. Counts combine before they are shuffled."""
    hosts = facts.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("base_failed").alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(
        (F.sum("n_failed") / F.sum("n_docs")).alias("m"),
        F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("v"),
    ).select(
        "m",
        F.when(F.col("v") <= 0, F.lit(rules.most_weight))
        .otherwise(F.least(F.greatest(F.col("m") * (1 - F.col("m")) / F.col("v") - 1, F.lit(rules.least_weight)), F.lit(rules.most_weight)))
        .alias("k"),
    )
    total = F.col("n_docs") + F.col("k")
    shrunk = (F.col("n_failed") + F.col("m") * F.col("k")) / total
    spread = F.sqrt(F.col("shrunk_rate") * (1 - F.col("shrunk_rate")) / (total + 1))
    # The prior is a global aggregate, so it is one row, whatever the input.
    return (
        hosts.join(F.broadcast(prior), F.lit(True))
        .withColumn("shrunk_rate", shrunk)
        .select("host", "n_docs", "n_failed", "shrunk_rate", (F.col("shrunk_rate") - rules.deviations * spread > rules.max_host_rate).alias("host_rejected"))
    )


def judge(docs: DataFrame, rules: QualityRules = QualityRules(), id_col: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row for each input row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, host_rate, host_rejected, kept.

    Null texts have no words and fail. A null host is a group of its own, which is never rejected.
    Repeated rows are judged and counted each. An empty table gives no rows. Other columns of docs,
    whatever their names, are not used.
    """
    thin = docs.select(F.col(id_col).alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(text).alias("text"))
    facts = materialize(document_facts(thin, rules).drop("text"), "quality")
    hosts = host_verdicts(facts, "host", rules).select("host", F.col("shrunk_rate").alias("host_rate"), "host_rejected")
    # A shuffled join where the hosts are many: the hot host's documents are then split by adaptive execution.
    judged = facts.join(hosts, "host", "left").withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
    kept = ~F.col("base_failed") & ~F.col("host_rejected")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate", "host_rejected", kept.alias("kept"))


def kept_documents(docs: DataFrame, rules: QualityRules = QualityRules(), text: str = "text", host: str = "source") -> DataFrame:
    """The rows of docs that judge() keeps, with docs' columns, whatever their names.

    Each row is judged where it is and written once, without its columns if it fails by itself; then the rejected
    hosts are taken out. They are broadcast if they are at most BROADCAST_HOSTS; beyond that texts are shuffled.
    Nulls, repeated rows and empty tables as in judge().
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    thin = docs.select(row.alias("_row"), F.col(f"`{host}`").cast("string").alias("host"), F.col(f"`{text}`").alias("text"))
    facts = document_facts(thin, rules)
    judged = materialize(facts.select(F.when(~F.col("base_failed"), F.col("_row")).alias("_row"), "host", "base_failed"), "judged")
    rejected = materialize(host_verdicts(judged, "host", rules).filter("host_rejected").select("host"), "rejected")
    if rejected.count() <= BROADCAST_HOSTS:
        rejected = F.broadcast(rejected)
    return judged.filter(~F.col("base_failed")).join(rejected, "host", "left_anti").select("_row.*")


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
g AS (
  SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i,
         unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS gram
  FROM w WHERE len(ws) >= 3),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
c AS (SELECT doc_id, sum(least(3, i - coalesce(prev, -9))) AS n_repeat_words
      FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM r) GROUP BY doc_id),
f AS (
  SELECT w.doc_id, host, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
h AS (SELECT host, count(*) AS n, sum(CASE WHEN base_failed THEN 1 ELSE 0 END) AS bad FROM b GROUP BY host),
p AS (SELECT sum(bad) / sum(n) AS m, coalesce(var_pop(bad / n), 0) AS v FROM h),
k AS (SELECT m, CASE WHEN v <= 0 THEN 1000.0 ELSE least(greatest(m * (1 - m) / v - 1, 2.0), 1000.0) END AS k FROM p),
s AS (SELECT host, (bad + m * k) / (n + k) AS rate, n + k AS total FROM h, k),
j AS (SELECT host, rate - 2.0 * sqrt(rate * (1 - rate) / (total + 1)) > 0.5 AS rejected FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(rejected, false) AS kept
FROM b LEFT JOIN j ON b.host = j.host
"""
