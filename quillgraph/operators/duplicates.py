"""Exact duplicates with an elected canonical path, near duplicates of a draft, semantic duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions import text as T
from quillgraph.operators.roles import path_role, role_rank

#: Fixed values.
MIN_TERMS, MIN_SHARED, MIN_COSINE, FREQUENT_RATIO, FREQUENT_LEAST = 6, 2, 0.55, 0.10, 5
STOPWORDS = tuple(
    "a an and are as at be been but by can could did do does for from had has have he her here him his how if "
    "in into is it its just like may me more most my no not of on or our out she so some than that the their them then "
    "there these they this those to too up us was we were what when where which who will with would you your "
    "и в во не на что я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня "
    "еще нет из ему когда даже если уже или ни быть был него до вас опять вам ведь там потом себя ничего ей может они тут где есть надо "
    "для мы тебя их чем была сам чтоб без будет тогда кто этот того потому этого какой совсем ним здесь этом один почти мой тем чтобы нее "
    "сейчас были куда зачем сказать всех никогда сегодня можно при наконец два об другой хоть после над больше тот через эти нас про всего них какая "
    "много разве три эту моя впрочем чуть том нельзя такой более всегда конечно всю между".split()
)


def exact_groups(files: DataFrame) -> DataFrame:
    """sha256, n, paths (sorted) of texts that several notes have."""
    return files.groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("path")).alias("paths")).filter("n > 1")


def group_examples(files: DataFrame, limit: int = 10) -> DataFrame:
    """sha256, n, paths of the largest groups, of equal ones the smallest hash first. Paths are gathered for those only."""
    largest = files.groupBy("sha256").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy(F.desc("n"), "sha256").limit(limit)
    return exact_groups(files.join(F.broadcast(largest.select("sha256")), "sha256", "left_semi"))


def assessed(files: DataFrame, degrees: DataFrame) -> DataFrame:
    """Members of duplicate groups with what the election compares: not_inbox, connectivity, mtime, rank, pref."""
    several = files.groupBy("sha256").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    role = path_role(F.col("path"))
    return (
        files.select("path", "sha256", "mtime")
        .join(several, "sha256")
        .join(degrees, "path")
        .select(
            "path", "sha256", "n", "out_links", "back_links", role.alias("role"),
            (F.coalesce(role, F.lit("")) != "inbox").cast("int").alias("not_inbox"),
            (F.col("out_links") + F.col("back_links")).alias("connectivity"), "mtime", role_rank(role).alias("rank"),
            F.struct(F.greatest(F.lit(20) - F.size(F.split("path", "/")), F.lit(0)).alias("short"), F.col("path").alias("p")).alias("pref"),
        )
    )


_ORDER = ("not_inbox", "connectivity", "mtime", "rank", "pref")


def canonical(members: DataFrame) -> DataFrame:
    """sha256, canonical_path: the greatest member by not being in the inbox, links, recency, role, path."""
    return members.groupBy("sha256").agg(F.max_by("path", F.struct(*_ORDER)).alias("canonical_path"))


def canonical_map(members: DataFrame) -> DataFrame:
    """path, canonical_path of all members of groups."""
    return members.select("path", "sha256").join(canonical(members), "sha256").select("path", "canonical_path")


def canonical_reasons(members: DataFrame) -> DataFrame:
    """sha256, canonical_path, reasons: by the maxima of the other members (each group's two greatest of a
    column say what the greatest of the others is)."""
    best = canonical(members)
    flagged = members.join(best, "sha256")
    win = F.col("path") == F.col("canonical_path")
    other = lambda c: F.max(F.when(~win, F.col(c)))
    own = lambda c: F.max(F.when(win, F.col(c)))
    sums = flagged.groupBy("sha256", "canonical_path").agg(
        *[own(c).alias("w_" + c) for c in (*_ORDER, "out_links", "back_links", "role")],
        *[other(c).alias("o_" + c) for c in _ORDER],
        F.min(F.when(~win, F.col("not_inbox"))).alias("o_least"),
    )
    beats = lambda c: F.col("w_" + c) > F.col("o_" + c)
    reasons = F.array_compact(
        F.array(
            F.when((F.col("w_not_inbox") == 1) & (F.col("o_least") == 0), "preferred over inbox paths"),
            F.when(beats("connectivity"), F.concat(F.lit("most connected duplicate ("), F.col("w_back_links"), F.lit(" backlinks, "), F.col("w_out_links"), F.lit(" outgoing links)"))),
            F.when(beats("mtime"), "newest duplicate copy"),
            F.when(beats("rank"), F.concat(F.lit("stronger vault role ("), F.coalesce("w_role", F.lit("unclassified")), F.lit(")"))),
            F.when(beats("pref"), "shorter, more stable path tie-break"),
        )
    )
    return sums.select("sha256", "canonical_path", F.when(F.size(reasons) == 0, "stable lexical tie-break on path").otherwise(F.array_join(reasons, "\n")).alias("reasons"))


def document_terms(docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """path, terms."""
    return docs.select("path", T.terms(F.concat_ws(" ", *columns)).alias("terms"))


def find_duplicates(drafts: DataFrame, docs: DataFrame, min_score: int = 20, stored: DataFrame | None = None) -> DataFrame:
    """draft_id, path, score of notes like a draft (draft_id, content): +70 for the same title, +50 for the
    same name, up to 60 for shared terms. Drafts are few; their terms meet the notes' terms by equality,
    and only what meets goes on. stored: rows of path, title and terms."""
    title = T.title_key(T.extract_title(F.col("content")))
    wanted = drafts.select("draft_id", title.alias("title_key"), T.terms(F.col("content")).alias("terms"))
    if stored is None:
        stored = docs.select("path", "title", T.terms(F.concat_ws(" ", "path_text", "title", "headings", "tags", "tasks", "body")).alias("terms"))
    of_doc = stored.select("path", T.title_key(F.col("title")).alias("doc_key"), T.fold(T.stem(F.col("path"))).alias("name"), F.col("terms").alias("doc_terms"))
    sized = of_doc.select("path", F.size("doc_terms").alias("doc_n"), F.explode("doc_terms").alias("term"))
    asked = wanted.select("draft_id", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    shared = sized.join(asked, "term").groupBy("draft_id", "path").agg(F.count(F.lit(1)).alias("k"), F.first("n").alias("n"), F.first("doc_n").alias("doc_n"))
    by_terms = shared.select("draft_id", "path", F.least(F.lit(60), F.bround(F.col("k") / F.greatest(F.lit(1), F.least("n", "doc_n")) * 100).cast("int")).alias("s"))
    keys = wanted.filter("title_key <> ''").select("draft_id", "title_key")
    by_title = of_doc.join(keys, F.col("doc_key") == F.col("title_key")).select("draft_id", "path", F.lit(70).alias("s"))
    by_name = of_doc.join(keys, F.col("name") == F.col("title_key")).select("draft_id", "path", F.lit(50).alias("s"))
    total = by_terms.unionByName(by_title).unionByName(by_name).groupBy("draft_id", "path").agg(F.sum("s").alias("score"))
    return total.filter(F.col("score") >= min_score)


def top(rows: DataFrame, by: str, limit: int) -> DataFrame:
    """The limit rows of each group of highest score, then smallest path."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), "path")
    return rows.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= limit).drop("_rank")


def group_of(files: DataFrame, path_or_group: str) -> str | None:
    """The hash of a path's duplicate group, None if it has no copies, or that of the one group that a sha256: prefix names."""
    sizes = files.groupBy("sha256").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    own = files.filter(F.col("path") == path_or_group).select("sha256").first()
    if own is not None:
        return own[0] if sizes.filter(F.col("sha256") == own[0]).take(1) else None
    if not path_or_group.startswith("sha256:"):
        raise FileNotFoundError(f"not in the index: {path_or_group}")
    prefix = path_or_group.split(":", 1)[1].strip().casefold()
    if not prefix:
        raise ValueError("a duplicate group needs an id")
    found = [r[0] for r in sizes.filter(F.col("sha256").startswith(prefix)).orderBy("sha256").limit(10).collect()]
    if len(found) != 1:
        raise ValueError(f"{'several groups' if found else 'no group'} of {path_or_group}: {', '.join('sha256:' + x[:12] for x in found)}")
    return found[0]


def inspect_duplicates(path_or_group: str, files: DataFrame, members: DataFrame, docs: DataFrame, stored: DataFrame | None = None, limit: int = 5) -> DataFrame:
    """kind, path, score, reasons: the copies of a note or of a group (canonical and exact), and the notes most like it
    (similar), each copy standing for its canonical one with the best score of its copies. Errors are raised for what
    is not in the index, or names no group or several."""
    sha = group_of(files, path_or_group)
    group = members.filter(F.col("sha256") == F.lit(sha))
    best = canonical(group).first()
    seed = best["canonical_path"] if best else path_or_group
    part = lambda c: F.when(F.col(c) != "", F.col(c))
    text = F.concat(F.when(F.col("title") != "", F.concat(F.lit("# "), "title", F.lit("\n\n"))).otherwise(""), F.concat_ws("\n", *map(part, ("headings", "tags", "tasks", "body"))))
    draft = docs.filter(F.col("path") == seed).select(F.lit(0).alias("draft_id"), text.alias("content"))
    like = top(find_duplicates(draft, docs, stored=stored), "draft_id", max(3 * limit, 10)).select("path", "score")
    placed = like.join(canonical_map(members), "path", "left").withColumn("to", F.coalesce("canonical_path", "path"))
    outside = placed.filter(F.col("to") != seed).join(group.select(F.col("path").alias("to")), "to", "left_anti")
    reason = F.when(F.col("to") != F.col("path"), F.concat(F.lit("exact duplicate canonicalized from "), "path"))
    merged = outside.groupBy("to").agg(F.max("score").alias("score"), F.array_join(F.array_sort(F.collect_set(reason)), "\n").alias("reasons"))
    similar = merged.orderBy(F.desc("score"), "to").limit(limit).select(F.lit("similar").alias("kind"), F.col("to").alias("path"), F.col("score").cast("long").alias("score"), "reasons")
    kind = F.when(F.col("path") == seed, "canonical").otherwise("exact").alias("kind")
    copies = group.select(kind, "path", F.lit(None).cast("long").alias("score"), F.lit("").alias("reasons"))
    return copies.unionByName(similar)


def semantic_terms(text: Column) -> Column:
    words = F.transform(T.tokens(F.regexp_replace(text, rf"(?i)(?:https?://|www\.)[^{T.SPACE}]+", " ")), T.fold)
    kept = F.filter(words, lambda t: (F.length(t) > 2) & t.rlike(r"\p{L}"))
    return F.array_except(F.array_distinct(kept), F.array(*[F.lit(x) for x in STOPWORDS]))


def term_idf(terms: DataFrame, total: DataFrame) -> DataFrame:
    """term, df, idf of exploded (path, term) rows, each once; total is one row with n."""
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(total), F.lit(True)).select("term", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def cosines(terms: DataFrame, limit_ratio: float = FREQUENT_RATIO, least_size: int = 1) -> DataFrame:
    """path_a, path_b, shared, cosine of notes that share a term which is not too frequent, path_a < path_b.
    The frequency limit is the reference's own; it bounds the self-join by postings. Notes of fewer than least_size
    such terms count in the weights only and meet no other."""
    total = terms.select("path").distinct().agg(F.count(F.lit(1)).alias("n"))
    weights = term_idf(terms, total).join(F.broadcast(total), F.lit(True)).filter(F.col("df") <= F.greatest(F.lit(FREQUENT_LEAST), F.ceil(F.col("n") * limit_ratio))).select("term", "idf")
    kept = terms.join(weights, "term")
    norms = kept.groupBy("path").agg(F.sum(F.col("idf") * F.col("idf")).alias("norm"), F.count(F.lit(1)).alias("size"))
    if least_size > 1:
        norms = norms.filter(F.col("size") >= least_size)
        kept = kept.join(norms.select("path"), "path", "left_semi")
    a = kept.select("term", "idf", F.col("path").alias("path_a"))
    b = kept.select("term", F.col("path").alias("path_b"))
    dots = a.join(b, "term").filter("path_a < path_b").groupBy("path_a", "path_b").agg(F.sum(F.col("idf") * F.col("idf")).alias("dot"), F.count(F.lit(1)).alias("shared"))
    na = norms.select(F.col("path").alias("path_a"), F.col("norm").alias("na"), F.col("size").alias("size_a"))
    nb = norms.select(F.col("path").alias("path_b"), F.col("norm").alias("nb"), F.col("size").alias("size_b"))
    joined = dots.join(na, "path_a").join(nb, "path_b")
    return joined.select("path_a", "path_b", "shared", "size_a", "size_b", (F.col("dot") / F.sqrt(F.col("na") * F.col("nb"))).alias("cosine"))


def informative(terms: DataFrame, total: DataFrame) -> DataFrame:
    """path, term, idf of exploded (path, term) rows, without terms of more than a share of the notes; total is one row with n."""
    limit = F.greatest(F.lit(FREQUENT_LEAST), F.ceil(F.col("n") * FREQUENT_RATIO))
    weights = term_idf(terms, total).join(F.broadcast(total), F.lit(True)).filter(F.col("df") <= limit).select("term", "idf")
    return terms.join(weights, "term")


def close_pairs(terms: DataFrame, least: float = MIN_COSINE, total: DataFrame | None = None) -> DataFrame:
    """The rows of cosines() of at least that cosine (rounded to 9 places), for notes of many terms. Terms have one
    order, the rarest first. The first term that two notes share begins all they share, so their cosine is at most
    the share of either's norm from that term on: only terms from which on enough is left meet in the join. total:
    one row with n, the number of notes, where some may have no term."""
    if total is None:
        total = terms.select("path").distinct().agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("path")
    square = F.col("idf") * F.col("idf")
    rest = F.sum(square).over(own.orderBy(F.desc("idf"), "term").rowsBetween(Window.currentRow, Window.unboundedFollowing))
    kept = informative(terms, total).withColumn("rest", rest).withColumn("norm", F.sum(square).over(own))
    meet = kept.filter(F.col("rest") >= F.col("norm") * (least * least - 1e-6)).select("term", "path")
    a, b = (meet.select("term", F.col("path").alias("path_" + x)) for x in "ab")
    pairs = a.join(b, "term").filter("path_a < path_b").select("path_a", "path_b").distinct()
    # Of each term a string with its weight before it: strings are intersected by hash, structs are not.
    whole = kept.groupBy("path").agg(F.collect_list(F.concat_ws(" ", F.col("idf").cast("string"), "term")).alias("terms"), F.first("norm").alias("norm"))
    for x in "ab":
        pairs = pairs.join(whole.select(*[F.col(c).alias(f"{c}_{x}") for c in whole.columns]), f"path_{x}")
    both = pairs.withColumn("both", F.array_intersect("terms_a", "terms_b"))
    weight = lambda t: F.substring_index(t, " ", 1).cast("double")
    dot = F.aggregate("both", F.lit(0.0), lambda sum_, t: sum_ + weight(t) * weight(t))
    found = both.select("path_a", "path_b", F.size("both").cast("long").alias("shared"), F.size("terms_a").alias("size_a"), F.size("terms_b").alias("size_b"), (dot / F.sqrt(F.col("norm_a") * F.col("norm_b"))).alias("cosine"))
    return found.filter(F.round("cosine", 9) >= least)


def name_tokens(name: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(T.tokens(name), lambda t: t.rlike(r"\p{L}")), T.fold))


def name_similarity(left: Column, right: Column) -> Column:
    """The larger share of the alphabetic words of either that both have; without words on a side, equality."""
    a, b = name_tokens(left), name_tokens(right)
    plain = lambda c: T.strip(F.regexp_replace(T.fold(c), rf"[{T.SPACE}]+", " "))
    both = F.size(F.array_intersect(a, b))
    share = F.greatest(both / F.greatest(F.size(a), F.lit(1)), both / F.greatest(F.size(b), F.lit(1)))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), ((plain(left) == plain(right)) & (plain(left) != "")).cast("double")).otherwise(share)
