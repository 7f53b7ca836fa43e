"""Where a draft belongs: evidence of similar notes, gathered on their folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions import text as T
from quillgraph.operators.roles import para_ancestors


def route(drafts: DataFrame, docs: DataFrame, threshold: int = 35, terms: DataFrame | None = None) -> DataFrame:
    """draft_id, destination, score: folders with enough evidence and none below them with nearly as much, and
    the inbox. Drafts are few; only notes that share terms with one go on. terms: stored rows of path and content_terms."""
    asked = drafts.select("draft_id", F.explode(T.terms(F.col("content"))).alias("term"))
    if terms is None:
        terms = docs.select("path", T.terms(F.concat_ws(" ", "title", "headings", "tags", "tasks", "body")).alias("content_terms"))
    terms = terms.select("path", F.explode("content_terms").alias("term"))
    hits = terms.join(asked.select("term").distinct(), "term")
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    total = docs.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n"))
    weights = asked.join(df, "term", "left").join(F.broadcast(total), F.lit(True)).select("draft_id", "term", (F.log((F.col("n") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1).alias("w"))
    mass = weights.groupBy("draft_id").agg(F.sum("w").alias("mass"))
    shared = hits.join(weights, "term").groupBy("draft_id", "path").agg(F.count(F.lit(1)).alias("k"), F.sum("w").alias("s")).filter("k >= 2")
    evidence = shared.join(mass, "draft_id").select("draft_id", "path", F.round(F.col("s") / F.col("mass"), 12).alias("e"))
    folders = para_ancestors(docs.select("path"))
    placed = evidence.join(folders, "path")
    w = Window.partitionBy("draft_id", "ancestor").orderBy(F.desc("e"), F.desc("path"), F.desc("depth"))
    best = placed.withColumn("r", F.row_number().over(w)).filter("r <= 3")
    support = best.groupBy("draft_id", "ancestor").agg((F.sum(F.when(F.col("r") == 1, F.col("e")).otherwise(F.col("e") * 0.25)) + F.least(F.first("depth"), F.lit(3)) * 0.03).alias("x"))
    scored = support.select("draft_id", "ancestor", F.bround(F.round(F.col("x") * 100, 9)).cast("int").alias("score")).filter(F.col("score") >= threshold)
    below = scored.select(F.col("draft_id").alias("d"), F.col("ancestor").alias("other"), F.col("score").alias("other_score"))
    # A folder and those above it: an equi-join on each candidate's own ancestors.
    up = below.withColumn("parts", F.split(F.rtrim(F.col("other"), F.lit("/")), "/")).select("d", "other", "other_score", F.explode(F.sequence(F.lit(1), F.size("parts") - 1)).alias("k"), "parts")
    covers = up.select("d", F.concat(F.array_join(F.slice("parts", F.lit(1), F.col("k")), "/"), F.lit("/")).alias("above"), "other_score")
    kept = scored.join(covers, (F.col("draft_id") == F.col("d")) & (F.col("ancestor") == F.col("above")) & (F.col("other_score") >= F.col("score") * 0.8), "left_anti")
    inbox = drafts.select("draft_id", F.lit("Inbox/").alias("ancestor"), F.lit(5).alias("score"))
    return kept.unionByName(inbox).withColumnRenamed("ancestor", "destination")


#: Fixed values.
LIMIT, SURE, INBOX = 5, 35, "Inbox/"


def ranked(routed: DataFrame, limit: int = LIMIT) -> DataFrame:
    """draft_id, rank, destination, score, confidence: the best destinations, of equal ones the deeper and then the smaller
    path first. A draft's confidence is high if its first one is no inbox and sure."""
    order = Window.partitionBy("draft_id").orderBy(F.desc("score"), F.desc(F.size(F.split(F.rtrim(F.col("destination"), F.lit("/")), "/"))), "destination")
    placed = routed.withColumn("rank", F.row_number().over(order))
    sure = F.max((F.col("rank") == 1) & (F.col("destination") != INBOX) & (F.col("score") >= SURE)).over(Window.partitionBy("draft_id"))
    kept = placed.withColumn("confidence", F.when(sure, "high").otherwise("low"))
    return kept.filter(F.col("rank") <= limit).select("draft_id", "rank", "destination", "score", "confidence")


def file_base(title: Column) -> Column:
    """A title as a file name without what file names can't hold."""
    base = F.regexp_replace(T.strip(F.regexp_replace(title, r'[\\/:*?"<>|]+', "-")), r"^\.+|\.+$", "")
    return F.when(base == "", "Untitled").otherwise(base)


def suggestions(drafts: DataFrame, routed: DataFrame, docs: DataFrame) -> DataFrame:
    """draft_id, destination, action, path: review a note of the same title or file name, else create a note,
    numbered where its name is taken."""
    title = T.extract_title(F.col("content"))
    named = drafts.select("draft_id", T.title_key(title).alias("key"), file_base(title).alias("base"))
    titles = docs.groupBy(T.title_key(F.col("title")).alias("key")).agg(F.min("path").alias("same_title")).filter("key <> ''")
    names = docs.groupBy(T.fold(T.stem(F.col("path"))).alias("name_key")).agg(F.max("path").alias("same_name"))
    wanted = routed.join(named, "draft_id").join(titles, "key", "left")
    # Numbers that are taken, by folder and base.
    taken = docs.select(F.concat(T.parent(F.col("path")), F.lit("/")).alias("destination"), T.file_name(F.col("path")).alias("name"))
    numbered = taken.select("destination", F.regexp_extract("name", r"^(.*?)(?: (\d+))?\.md$", 1).alias("base"), F.regexp_extract("name", r"^(.*?)(?: (\d+))?\.md$", 2).alias("k"))
    used = numbered.groupBy("destination", "base").agg(F.collect_set(F.when(F.col("k") == "", F.lit(1)).otherwise(F.col("k").cast("int"))).alias("used"))
    free = F.array_min(F.array_except(F.sequence(F.lit(1), F.size(F.coalesce("used", F.array().cast("array<int>"))) + 1), F.coalesce("used", F.array().cast("array<int>"))))
    placed = wanted.join(used, ["destination", "base"], "left").withColumn("k", free)
    file = F.concat(F.col("base"), F.when(F.col("k") > 1, F.concat(F.lit(" "), F.col("k").cast("string"))).otherwise(""))
    checked = placed.withColumn("file", file).withColumn("name_key", T.fold(F.col("file"))).join(names, "name_key", "left")
    found = F.coalesce("same_title", "same_name")
    return checked.select("draft_id", "destination", F.when(found.isNull(), "create").otherwise("review").alias("action"), F.coalesce(found, F.concat("destination", "file", F.lit(".md"))).alias("path"))
