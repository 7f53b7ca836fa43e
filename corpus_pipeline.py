"""The corpus pipeline: quality rules, near-duplicate removal, repeated-passage removal, benchmark
decontamination, packing. Each stage is one of the operators of quillgraph.llm.

A stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame;
run() writes it as Parquet to the shared folder and rereads it as the next stage's docs. All but the
last return the columns of documents. When a stage begins, the tables that earlier stages' results were read
from are deleted, as those results have been written by then; not those that docs itself still reads.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import decontaminate, jaccard, packing, quality, repeats, tokens
from quillgraph.llm.common import delete, materialize, scratch, ship, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Words that a worker of the packing stage keeps with their tokens, as it shares an executor with the other stages.
WORDS = 60_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: By place of the stage: paths of the tables that its last results read.
_left: dict[int, list[str]] = {}


def _stage(place: int):
    def wrap(f):
        @wraps(f)
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            ship(spark)
            earlier = [p for k in _left if k < place for p in _left[k]]
            used = "\n".join(docs.inputFiles()) if earlier else ""
            for path in earlier:
                if path.split(":")[-1] not in used:
                    delete(spark, path)
            for k in _left:
                if k < place:
                    _left[k] = [p for p in _left[k] if p.split(":")[-1] in used]
            with scratch() as made:
                out = f(spark, docs, sf_dir)
            _left[place] = _left.get(place, []) + made
            return out

        return run

    return wrap


def _columns(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


@_stage(0)
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, or whose host fails as a whole, go. Each row is judged, those with a
    null or repeated id too."""
    return quality.kept_documents(_columns(docs))


@_stage(1)
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the one with the smallest id stays; of rows with equal id and
    text one stays. Rows with a null id are linked with nothing, and all stay."""
    docs = _columns(docs)
    found = jaccard.similar_components(docs)
    gone = found.filter("component_id <> doc_id").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti")
    if found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").take(1):
        left = left.filter("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(docs.filter("doc_id is null"))
    return _columns(left)


@_stage(2)
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages that an earlier document (or place) holds go. A cut within a character drops the
    character's other bytes; a document of which nothing is left goes. n_chars is counted anew."""
    found = repeats.remove_repeats(_columns(docs))
    # Of a cut text, bytes that are no character any more go: the ends of cut characters.
    whole = F.col("kept").cast("string")
    text = F.when(F.col("n_removed") == 0, whole).otherwise(F.replace(F.make_valid_utf8(whole), F.lit("\ufffd"), F.lit("")))
    rows = found.select(*[F.col(f"_row.{c}").alias(c) for c in COLUMNS if c not in ("text", "n_chars")], text.alias("text"), "n_removed", F.col("_row.n_chars").alias("_n"))
    kept = rows.filter((F.col("n_removed") == 0) | (F.trim(F.col("text"), F.lit(" \t\n\r")) != ""))
    return _columns(kept.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("_n")).otherwise(F.length("text").cast("long"))))


@_stage(3)
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    found = decontaminate.contain(_columns(docs), table(spark, sf_dir, "benchmark"))
    return _columns(found.filter("_dc.n_hit = 0"))


@_stage(4)
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packing plan of the documents' tokens: one row for each piece."""
    return packing.pack(materialize(tokens.token_lengths(docs, TOKENIZER, most=WORDS), "lengths"), F.col("n_tokens"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the near duplicates' components, byte spans and packing. tests/llm/test_pipeline.py holds the stages against brute
#: force (decontamination in part: items of ten words and more; the quality rules against their SQL); run() as a whole is not tested so.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before: list[str] = []
    for name, stage in STAGES[:-1]:
        with scratch() as made:
            docs = materialize(stage(spark, docs, sf_dir), name)
        for path in before:
            delete(spark, path)
        before = made
    return STAGES[-1][1](spark, docs, sf_dir)
