"""One query for each operator of the document-vault engine, over the corpus derived from documents."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import duplicates as D
from quillgraph.operators import facts, links, maintenance, related, roles, routing, search, semantic, structure
from quillgraph.plans.corpus import notes
from quillgraph.plans.index import VaultIndex
from quillgraph.plans.store import VaultStore, shared_folder, stored_notes

QUERY = "the and"
SECTION = "links"
LIMIT_CHARS = 60
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def stored_index(spark: SparkSession, sf_dir: str) -> VaultIndex:
    """The corpus' persisted index, which is built when a session first asks for it."""
    store = stored_notes(spark, sf_dir, f"{sf_dir}/documents.parquet", notes(spark, sf_dir))
    return VaultIndex(store.notes(), store=store)


def query(f: Callable[[VaultIndex, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Registers a function of the corpus' index and its notes under its name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ix = stored_index(spark, sf_dir)
        return f(ix, ix.notes)

    QUERIES[f.__name__] = run
    return run


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """draft_id, content: the benchmark's passages as drafts."""
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("draft_id"), F.col("text").alias("content"))


def with_drafts(f: Callable[[VaultIndex, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(stored_index(spark, sf_dir), drafts(spark, sf_dir))

    QUERIES[f.__name__] = run
    return run


@query
def folder_link_status(ix, n):
    """Links of each top folder by what they mean."""
    return ix.links.groupBy(F.substring_index("path", "/", 1).alias("folder"), "status").agg(F.count(F.lit(1)).alias("n"))


@query
def md_lines(ix, n):
    return facts.md_lines(n).select("path", "line", "text")


@query
def md_outside_fences(ix, n):
    return facts.body_lines(n)


@query
def headings(ix, n):
    return facts.headings(n)


@query
def tasks(ix, n):
    return facts.tasks(n)


@query
def wikilinks(ix, n):
    return facts.wikilinks(n)


@query
def tags(ix, n):
    return ix.tags.select("path", "line", "tag")


@query
def frontmatter(ix, n):
    return ix.metadata


@query
def extract_title(ix, n):
    return n.select("path", T.extract_title(F.col("text")).alias("title"))


@query
def sections(ix, n):
    return facts.sections(n)


@query
def read_section(ix, n):
    return facts.read_section(n, SECTION)


@query
def read_truncated(ix, n):
    return n.select("path", facts.truncated(F.col("text"), LIMIT_CHARS).alias("text"))


@query
def umbrella_like(ix, n):
    return ix.docs.select("path", facts.umbrella_document().alias("umbrella_like"))


@query
def path_role(ix, n):
    return n.select("path", roles.path_role(F.col("path")).alias("role"))


@query
def path_parts(ix, n):
    p = F.col("path")
    return n.select("path", T.parent(p).alias("parent"), T.file_name(p).alias("name"), T.stem(p).alias("stem"), T.suffix(p).alias("suffix"), F.size(F.split(p, "/")).alias("parts"))


@query
def note_role(ix, n):
    return ix.note_roles


@query
def role_missing(ix, n):
    return ix.missing_roles


@query
def role_invalid(ix, n):
    return roles.role_invalid(ix.metadata)


@query
def link_resolution(ix, n):
    return ix.links.select("path", "line", "seq", "target", "resolved_path", "status", F.array_join("candidates", "\n").alias("candidates"))


@query
def preferred_link(ix, n):
    return ix.links.filter("status = 'ambiguous'").select("path", "line", "seq", "preferred_path")


@query
def links_ambiguous(ix, n):
    return ix.links.filter("status = 'ambiguous'").select("path", "line", "target")


@query
def links_missing(ix, n):
    return ix.links.filter("status = 'missing'").select("path", "line", "target")


@query
def outgoing_links(ix, n):
    return ix.links.groupBy("path").agg(F.array_join(F.array_distinct(F.array_sort(F.collect_list(F.coalesce("resolved_path", "preferred_path", "target")))), "\n").alias("links"))


@query
def backlinks(ix, n):
    return links.backlinks(ix.links).select("path", "source", "line")


@query
def umbrella_backlinks(ix, n):
    umbrella = ix.note_roles.filter("role = 'umbrella'").select(F.col("path").alias("source"))
    return links.backlinks(ix.links).join(umbrella, "source", "left_semi").select("path", "source").distinct()


@query
def link_degrees(ix, n):
    return ix.degrees


@query
def shortest_links(ix, n):
    return links.shortest_links(n)


@query
def exact_dup_groups(ix, n):
    return D.exact_groups(ix.files).join(D.canonical(ix.members), "sha256").select(F.concat(F.lit("sha256:"), F.substring("sha256", 1, 12)).alias("group_id"), "n", F.array_join("paths", "\n").alias("paths"), "canonical_path")


@query
def exact_dup_paths(ix, n):
    several = D.exact_groups(ix.files)
    return ix.files.join(several, "sha256").select("path", F.array_join("paths", "\n").alias("paths"))


@query
def dup_examples(ix, n):
    """The ten largest groups of equal notes."""
    return D.group_examples(ix.files).select("sha256", "n", F.array_join("paths", "\n").alias("paths"))


@query
def inspect_duplicates(ix, n):
    """The largest group of equal notes, and the notes most like it."""
    group = D.group_examples(ix.files, 1).first()
    return D.inspect_duplicates(f"sha256:{group['sha256']}" if group else n.select(F.min("path")).first()[0], ix.files, ix.members, ix.docs, ix.terms)


@query
def dup_group_count(ix, n):
    return D.exact_groups(ix.files).agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("files"))


@query
def canonical_paths(ix, n):
    return n.select("path").join(D.canonical_map(ix.members), "path", "left").select("path", F.coalesce("canonical_path", "path").alias("canonical_path"))


@query
def canonical_reasons(ix, n):
    return D.canonical_reasons(ix.members).select("canonical_path", "reasons")


@query
def index_info(ix, n):
    groups = D.exact_groups(ix.files).agg(F.count(F.lit(1)).alias("dup_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("dup_files"))
    return n.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.lower(T.suffix(F.col("path"))).isin(".md", ".markdown")).alias("markdown_files")).join(groups, F.lit(True))


def earlier_notes(n: DataFrame) -> DataFrame:
    changed = F.when(F.col("doc_id") % 17 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    return n.drop("sha256", "size_bytes").filter("doc_id % 13 <> 0").withColumn("text", changed)


def previous_files(n: DataFrame) -> DataFrame:
    """A stand-in for an earlier scan: some notes were not there, some had another text."""
    return VaultIndex(earlier_notes(n)).files


def later_files(n: DataFrame) -> DataFrame:
    """What is there now: some of the notes are gone."""
    return VaultIndex(n.filter("doc_id % 19 <> 0")).files


@query
def scan_delta(ix, n):
    return maintenance.scan_delta(later_files(n), previous_files(n))


@query
def scan_counters(ix, n):
    return maintenance.scan_counters(maintenance.scan_delta(later_files(n), previous_files(n)))


@query
def index_drift(ix, n):
    return maintenance.drift(later_files(n), previous_files(n))


@query
def upsert_files(ix, n):
    delta = maintenance.scan_delta(later_files(n), previous_files(n))
    changed = later_files(n).join(delta.filter("change in ('new', 'changed')"), "path", "left_semi")
    kept = maintenance.cascade_delete(previous_files(n), delta.filter("change = 'deleted'"))
    return maintenance.upsert(kept, changed)


@query
def cascade_delete(ix, n):
    delta = maintenance.scan_delta(later_files(n), previous_files(n))
    return maintenance.cascade_delete(facts.headings(n), delta.filter("change = 'deleted'")).select("path", "line", "heading")


def refreshed(ix: VaultIndex, n: DataFrame) -> VaultStore:
    """An index of the earlier scan that was then brought to what is there now."""
    raw = n.select("path", "text", "mtime", "doc_id")
    store = VaultStore(n.sparkSession, f"{shared_folder(n.sparkSession)}/refresh-{uuid.uuid4().hex}")
    store.refresh(earlier_notes(raw))
    store.refresh(raw.filter("doc_id % 19 <> 0"))
    return store


@query
def index_refresh(ix, n):
    """The files and facts of an incrementally refreshed index."""
    count = lambda c: F.size(c).cast("long")
    return refreshed(ix, n).notes().select("path", "size_bytes", "sha256", count("heading_rows").alias("n_headings"), count("link_rows").alias("n_links"))


@query
def index_meta(ix, n):
    """The counters that the refreshed index keeps of its last scan."""
    meta = refreshed(ix, n).meta()
    names = ("version", "previous", "file_count", "changed_count", "deleted_count", "unchanged_count")
    return n.sparkSession.createDataFrame([tuple(meta[x] for x in names)], ", ".join(f"{x} long" for x in names))


@query
def doc_terms(ix, n):
    return D.document_terms(ix.docs, ("title", "headings", "tags")).select("path", F.explode("terms").alias("term"))


@query
def title_keys(ix, n):
    return n.select("path", T.title_key(T.extract_title(F.col("text"))).alias("title_key"))


@query
def title_collisions(ix, n):
    keys = n.select("path", T.title_key(T.extract_title(F.col("text"))).alias("title_key")).filter("title_key <> ''")
    return keys.groupBy("title_key").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path")).filter("n > 1")


def semantic_rows(ix: VaultIndex) -> DataFrame:
    text = F.concat_ws("\n", "title", "headings", "tags", "tasks")
    return ix.docs.select("path", F.explode(D.semantic_terms(text)).alias("term"))


@query
def term_idf(ix, n):
    return D.term_idf(semantic_rows(ix), n.agg(F.count(F.lit(1)).alias("n"))).select("term", "df", F.round("idf", 6).alias("idf"))


@query
def tfidf_cosine(ix, n):
    return D.cosines(semantic_rows(ix)).filter("shared >= 2").select("path_a", "path_b", "shared", F.round("cosine", 6).alias("cosine"))


@query
def semantic_candidates(ix, n):
    """Pairs of notes in different folders with enough terms in common, for review."""
    rows = D.cosines(semantic_rows(ix), least_size=D.MIN_TERMS).filter((F.col("shared") >= D.MIN_SHARED) & (F.round("cosine", 9) >= D.MIN_COSINE))
    apart = rows.filter(T.parent(F.col("path_a")) != T.parent(F.col("path_b")))
    return apart.select("path_a", "path_b", F.bround(F.round(F.col("cosine") * 100, 6)).cast("int").alias("score"))


def whole_semantic_rows(ix: VaultIndex) -> DataFrame:
    """As semantic_rows, with the body: all of the text that the original compares."""
    parts = [*(F.col(c) for c in ("title", "headings", "tags", "tasks")), facts.without_frontmatter(F.col("body"))]
    return ix.docs.select("path", F.explode(D.semantic_terms(F.concat_ws("\n", *parts))).alias("term"))


@query
def semantic_candidates_body(ix, n):
    """semantic_candidates over title, headings, tags, tasks and body."""
    rows = D.close_pairs(whole_semantic_rows(ix)).filter((F.least("size_a", "size_b") >= D.MIN_TERMS) & (F.col("shared") >= D.MIN_SHARED))
    apart = rows.filter(T.parent(F.col("path_a")) != T.parent(F.col("path_b")))
    return apart.select("path_a", "path_b", F.bround(F.round(F.col("cosine") * 100, 6)).cast("int").alias("score"))


@query
def semantic_duplicates(ix, n):
    """Findings of notes that may say the same, over all of their text."""
    rows = semantic.compared(ix.docs, ix.note_roles, ix.files)
    return semantic.findings(semantic.chosen(semantic.scored_candidates(rows), shared_folder(n.sparkSession)))


@query
def name_similarity(ix, n):
    """Same-folder notes whose names are alike, blocked by folder and a shared word of the name."""
    words = n.select("path", T.parent(F.col("path")).alias("dir"), T.stem(F.col("path")).alias("stem"), F.explode(D.name_tokens(T.stem(F.col("path")))).alias("w"))
    a, b = (words.select("dir", "w", F.col("path").alias("path_" + x), F.col("stem").alias("stem_" + x)) for x in "ab")
    pairs = a.join(b, ["dir", "w"]).filter("path_a < path_b").select("path_a", "path_b", "stem_a", "stem_b").distinct()
    return pairs.select("path_a", "path_b", F.round(D.name_similarity(F.col("stem_a"), F.col("stem_b")), 6).alias("similarity")).filter("similarity >= 0.85")


@query
def search_bm25(ix, n):
    best = search.bm25(ix.postings, ix.doc_lengths, ix.notes, search.phrases(n.sparkSession, search.query_tokens(QUERY)), True)
    return best.select("path", F.round("score", 6).alias("score")).orderBy("score", "path").limit(10)


@query
def search_snippet(ix, n):
    return search.search(ix.docs, QUERY, index=ix.postings, length=ix.doc_lengths).select("path", F.round("score", 6).alias("score"), "snippet")


def busiest(ix: VaultIndex) -> str:
    """The note with the most links, the smallest path of those."""
    return ix.degrees.orderBy(F.desc(F.col("out_links") + F.col("back_links")), "path").first()["path"]


@query
def related_lexical(ix, n):
    return related.lexical_pool(ix.docs, busiest(ix), ix.postings, ix.doc_lengths).select("path", F.array_join("overlap", " ").alias("overlap"))


@query
def related_notes(ix, n):
    return related.related(busiest(ix), n, ix.docs, ix.links, ix.tags, D.canonical_map(ix.members), ix.postings, ix.doc_lengths)


@query
def inspect(ix, n):
    """All that is known of each note, as counts and its canonical copy."""
    count = lambda df, name: df.groupBy("path").agg(F.count(F.lit(1)).alias(name))
    out = ix.files.join(ix.degrees, "path").join(ix.note_roles, "path").join(D.canonical_map(ix.members), "path", "left")
    for df, name in ((facts.headings(n), "n_headings"), (ix.tags.select("path", "tag").distinct(), "n_tags"), (facts.tasks(n), "n_tasks")):
        out = out.join(count(df, name), "path", "left")
    return out.select("path", "size_bytes", "role", "out_links", "back_links", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_headings", "n_tags", "n_tasks")], F.coalesce("canonical_path", "path").alias("canonical_path"))


@with_drafts
def find_duplicates(ix, d):
    return D.top(D.find_duplicates(d, ix.docs, stored=ix.terms), "draft_id", 5)


@query
def para_ancestors(ix, n):
    return roles.para_ancestors(n.select("path"))


@with_drafts
def route(ix, d):
    return routing.route(d, ix.docs, threshold=10, terms=ix.terms)


@with_drafts
def route_ranked(ix, d):
    """The best destinations of each draft, as a user gets them."""
    return routing.ranked(routing.route(d, ix.docs, terms=ix.terms))


@with_drafts
def route_suggestion(ix, d):
    return routing.suggestions(d, routing.route(d, ix.docs, threshold=10, terms=ix.terms), ix.docs)


@query
def structure_profiles(ix, n):
    return structure.profiles(ix.files)


@query
def profile_top_tags(ix, n):
    return structure.top_tags(ix.files, ix.tags)


@query
def profile_top_terms(ix, n):
    return structure.top_terms(ix.files, ix.docs)


def missing_roots(n: DataFrame) -> DataFrame:
    """Required folders that no note is in, against the notes outside the archive."""
    wanted = n.sparkSession.createDataFrame([(x,) for x in roles.REQUIRED_ROOTS], "dir string")
    there = n.filter(~roles.archived(F.col("path"))).select(F.concat(F.substring_index("path", "/", 1), F.lit("/")).alias("dir")).distinct()
    return wanted.join(there, "dir", "left_anti")


@query
def layout_missing(ix, n):
    return missing_roots(n)


@query
def dir_source_counts(ix, n):
    return roles.dir_source_counts(n.select("path"))


def folders(n: DataFrame) -> DataFrame:
    """path, children: the folders of an earlier scan and how many notes are there now, and some that are no notes' folders."""
    folder = F.concat(T.parent(F.col("path")), F.lit("/"))
    there = n.groupBy(folder.alias("path")).agg(F.count_if(F.col("doc_id") % 5 != 0).cast("int").alias("children"))
    other = [("Areas/none/", 0), ("Misc/old", 0), ("Misc/full/", 2), ("Resources/", 0), ("Projects/.git/", 0), ("venv/lib/", 0), ("Projects/P1/none/", 0), ("Skipped/x/", 0)]
    return there.unionByName(n.sparkSession.createDataFrame(other, "path string, children int"))


@query
def empty_directories(ix, n):
    return maintenance.empty_directories(folders(n), n.filter("doc_id % 5 <> 0").select("path"), ("Skipped/",))


def findings(ix: VaultIndex) -> DataFrame:
    groups = D.canonical(ix.members)
    bad = ix.links.select("path", "target", "status")
    f = maintenance.finding
    return maintenance.report(
        f(missing_roots(ix.notes), "missing_para_directory", "high", "dir", F.col("dir")),
        f(groups, "exact_duplicate", "medium", "canonical_path", F.substring("sha256", 1, 12)),
        f(bad.filter("status = 'ambiguous'"), "ambiguous_wikilink", "medium", "path", F.col("target")),
        f(bad.filter("status = 'missing'"), "missing_wikilink", "medium", "path", F.col("target")),
        f(roles.role_invalid(ix.metadata), "invalid_role_marker", "medium", "path", F.col("invalid_values")),
        f(ix.missing_roles.filter("role_hint = 'umbrella'"), "missing_role_marker", "medium", "path", F.col("role_hint")),
        f(ix.missing_roles.filter("role_hint = 'source'"), "missing_role_marker", "low", "path", F.col("role_hint")),
    )


@query
def maintenance_report(ix, n):
    return findings(ix)


@query
def finding_counts(ix, n):
    return findings(ix).groupBy("type", "severity").agg(F.count(F.lit(1)).alias("n"))
