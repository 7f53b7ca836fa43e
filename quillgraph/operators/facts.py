"""Facts of Markdown texts: lines, headings, tasks, links, tags, frontmatter, sections. All are narrow:
each row of notes (path, text) is parsed where it is, by built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions import text as T

HEADING = rf"^(#{{1,6}})[{T.SPACE}]+(.+?)[{T.SPACE}]*#*[{T.SPACE}]*$"
TASK = rf"^[{T.SPACE}]*[-*][{T.SPACE}]+\[([ xX])\][{T.SPACE}]+(.*)$"
FENCE = rf"^[{T.SPACE}]*(```|~~~)"
DELIMITER = rf"^---[{T.SPACE}]*$"
LINK = r"(?<!!)\[\[([^\]\n]+)\]\]"
#: Fixed value: the letters that a tag may begin with.
_LETTER = "A-Za-zА-Яа-я"
TAG = rf"(?<![\p{{L}}\p{{N}}_/-])#([{_LETTER}0-9][\p{{L}}\p{{N}}_/-]*)"


def _fenced_spans(lines: Column, after: Column) -> Column:
    """First and last line of each fenced block below `after`; a fence is closed by its own marker only, and
    one that is never closed reaches to the end. A fold over the fence lines alone."""
    marks = F.filter(
        F.transform(lines, lambda x, i: F.struct((i + 1).alias("i"), F.regexp_extract(x, FENCE, 1).alias("m"))),
        lambda s: (s["m"] != "") & (s["i"] > after),
    )
    start = F.struct(F.lit("").alias("m"), F.lit(0).alias("o"), F.array().cast("array<struct<a:int,b:int>>").alias("spans"))

    def step(acc, s):
        opened = F.struct(s["m"].alias("m"), s["i"].alias("o"), acc["spans"].alias("spans"))
        closed = F.struct(F.lit("").alias("m"), F.lit(0).alias("o"), F.concat(acc["spans"], F.array(F.struct(acc["o"].alias("a"), s["i"].alias("b")))).alias("spans"))
        return F.when(acc["m"] == "", opened).when(acc["m"] == s["m"], closed).otherwise(acc)

    def finish(acc):
        rest = F.when(acc["m"] != "", F.array(F.struct(acc["o"].alias("a"), F.lit(2147483647).alias("b")))).otherwise(F.array().cast("array<struct<a:int,b:int>>"))
        return F.concat(acc["spans"], rest)

    return F.aggregate(marks, start, step, finish)


def _split(notes: DataFrame, *keep: str) -> DataFrame:
    """path, lines, fm_end (the last line of the frontmatter, 0 for none) and spans of fenced lines."""
    parsed = notes.select(*keep, T.lines(F.col("text")).alias("lines"))
    opens = F.coalesce(F.get("lines", F.lit(0)).rlike(DELIMITER), F.lit(False))
    close = F.try_element_at(F.filter(F.transform("lines", lambda x, i: F.when((i > 0) & x.rlike(DELIMITER), i + 1)), lambda i: i.isNotNull()), F.lit(1))
    parsed = parsed.withColumn("fm_end", F.when(opens, F.coalesce(close, F.size("lines"))).otherwise(0))
    # The frontmatter's lines between its delimiters; all others where it isn't closed.
    parsed = parsed.withColumn("fm", F.when(opens, F.slice("lines", 2, F.greatest(F.coalesce(close - 1, F.size("lines")) - 1, F.lit(0)))))
    return parsed.withColumn("spans", _fenced_spans(F.col("lines"), F.col("fm_end")))


def md_lines(notes: DataFrame) -> DataFrame:
    """path, line, text, in_frontmatter, fenced."""
    exploded = _split(notes, "path").select("path", "fm_end", "spans", F.posexplode("lines").alias("at", "text"))
    line = F.col("at") + 1
    return exploded.select(
        "path",
        line.cast("int").alias("line"),
        "text",
        (line <= F.col("fm_end")).alias("in_frontmatter"),
        ((line > F.col("fm_end")) & F.exists("spans", lambda s: (F.col("at") + 1 >= s["a"]) & (F.col("at") + 1 <= s["b"]))).alias("fenced"),
    )


def body_lines(notes: DataFrame) -> DataFrame:
    """path, line, text of the lines that are parsed: outside frontmatter and fences."""
    return md_lines(notes).filter(~F.col("in_frontmatter") & ~F.col("fenced")).select("path", "line", "text")


#: The columns that parse() adds.
PARSED = ("heading_rows", "task_rows", "link_rows", "tag_rows", "metadata_rows")


def parse(notes: DataFrame) -> DataFrame:
    """notes with one array of rows for each kind of fact: headings, tasks, links, tags, metadata. All facts of a note
    come from one pass over its lines, in its own row; nothing is shuffled. Columns of these names are replaced."""
    kept = [c for c in notes.columns if c not in PARSED]
    lines = _split(notes.withColumn("_note", F.struct(*kept)), "_note")
    numbered = F.transform("lines", lambda x, i: F.struct((i + 1).cast("int").alias("line"), x.alias("text")))
    open_ = F.filter(numbered, lambda x: (x["line"] > F.col("fm_end")) & ~F.exists("spans", lambda s: (x["line"] >= s["a"]) & (x["line"] <= s["b"])))
    body = lines.select("_note", "fm", open_.alias("body"))

    def link(x, raw, seq):
        parts = F.split(T.strip(raw), r"\|", 2)
        return F.struct(x["line"].alias("line"), seq.cast("int").alias("seq"), T.strip(F.split(F.get(parts, F.lit(0)), "#", 2)[0]).alias("target"), T.strip(F.get(parts, F.lit(1))).alias("alias"))

    found = body.select(
        "_note",
        F.transform(F.filter("body", lambda x: x["text"].rlike(HEADING)), lambda x: F.struct(x["line"].alias("line"), F.length(F.regexp_extract(x["text"], HEADING, 1)).alias("level"), T.strip(F.regexp_extract(x["text"], HEADING, 2)).alias("heading"))).alias(PARSED[0]),
        F.transform(F.filter("body", lambda x: x["text"].rlike(TASK)), lambda x: F.struct(x["line"].alias("line"), (F.lower(F.regexp_extract(x["text"], TASK, 1)) == "x").alias("done"), T.strip(F.regexp_extract(x["text"], TASK, 2)).alias("task"))).alias(PARSED[1]),
        F.flatten(F.transform(F.filter("body", lambda x: x["text"].contains("[[")), lambda x: F.transform(F.regexp_extract_all(x["text"], F.lit(LINK), F.lit(1)), lambda raw, i: link(x, raw, i)))).alias(PARSED[2]),
        F.concat(
            F.coalesce(_frontmatter_tags(F.col("fm")), F.array().cast(_TAGS)),
            F.flatten(F.transform(F.filter("body", lambda x: x["text"].contains("#")), lambda x: F.transform(F.regexp_extract_all(x["text"], F.lit(TAG), F.lit(1)), lambda t, i: F.struct(x["line"].alias("line"), i.cast("int").alias("seq"), F.concat(F.lit("#"), t).alias("tag"))))),
        ).alias(PARSED[3]),
        F.coalesce(_metadata(F.col("fm")), F.array().cast(_ROWS)).alias(PARSED[4]),
    )
    return found.select("_note.*", *PARSED)


def _rows(notes: DataFrame, column: str) -> DataFrame:
    """The rows of one kind, of parsed notes or of such that are parsed for it."""
    parsed = notes if column in notes.columns else parse(notes.select("path", "text"))
    return parsed.select("path", F.inline(column))


def headings(notes: DataFrame) -> DataFrame:
    """path, line, level, heading."""
    return _rows(notes, PARSED[0])


def tasks(notes: DataFrame) -> DataFrame:
    """path, line, done, task."""
    return _rows(notes, PARSED[1])


def wikilinks(notes: DataFrame) -> DataFrame:
    """path, line, seq, target, alias; embeds are no links."""
    return _rows(notes, PARSED[2])


def tags(notes: DataFrame) -> DataFrame:
    """path, line, seq, tag: of the frontmatter and the body, with #."""
    return _rows(notes, PARSED[3])


def frontmatter(notes: DataFrame) -> DataFrame:
    """path, key, value: one row for each value."""
    return _rows(notes, PARSED[4])


def _clean(c: Column) -> Column:
    return F.regexp_replace(T.strip(c), "^['\"]+|['\"]+$", "")


_ROWS = "array<struct<key:string,value:string>>"
_TAGS = "array<struct<line:int,seq:int,tag:string>>"


def _metadata(fm: Column) -> Column:
    """key, value rows, one for each value, by a fold over the frontmatter's lines, as what `- x` means depends on
    the key that is open."""
    start = F.struct(F.lit(None).cast("string").alias("open"), F.array().cast(_ROWS).alias("out"))

    def step(acc, line):
        s = T.strip(line)
        item = _clean(F.substring(s, 3, 1 << 30))
        colon = F.locate(":", s)
        key = T.strip(F.substring(s, F.lit(1), colon - 1))
        value = T.strip(F.substring(s, colon + 1, F.lit(1 << 30)))
        listed = F.filter(F.transform(F.split(F.substring(value, F.lit(2), F.length(value) - 2), ","), _clean), lambda v: v != "")
        values = F.when(value.startswith("[") & value.endswith("]") & (F.length(value) > 1), listed).otherwise(F.filter(F.array(_clean(value)), lambda v: v != ""))
        new = lambda open_, out: F.struct(open_.alias("open"), out.alias("out"))
        none = F.lit(None).cast("string")
        return (
            F.when(s == "", acc)
            .when(acc["open"].isNotNull() & s.startswith("- "), new(acc["open"], F.when(item == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(acc["open"].alias("key"), item.alias("value")))))))
            .when((colon == 0) | (key == ""), new(none, acc["out"]))
            .when(value == "", new(key, acc["out"]))
            .otherwise(new(none, F.concat(acc["out"], F.transform(values, lambda v: F.struct(key.alias("key"), v.alias("value"))))))
        )

    return F.aggregate(fm, start, step, lambda acc: acc["out"])


def _frontmatter_tags(fm: Column) -> Column:
    rows = "array<struct<line:int,raw:string>>"
    start = F.struct(F.lit(False).alias("open"), F.lit(1).alias("line"), F.array().cast(rows).alias("out"))

    def step(acc, text):
        s, line = T.strip(text), acc["line"] + 1
        inline = T.strip(F.substring(s, 6, 1 << 30))
        item = T.strip(F.substring(s, 3, 1 << 30))
        new = lambda open_, out: F.struct(open_.alias("open"), line.alias("line"), out.alias("out"))
        more = lambda v: F.concat(acc["out"], F.array(F.struct(line.alias("line"), F.regexp_replace(v, r"^[\[\]]+|[\[\]]+$", "").alias("raw"))))
        return (
            F.when(s == "", new(acc["open"], acc["out"]))
            .when(s.startswith("tags:") & (inline == ""), new(F.lit(True), acc["out"]))
            .when(s.startswith("tags:"), new(F.lit(False), more(inline)))
            .when(acc["open"] & s.startswith("- "), new(F.lit(True), more(item)))
            .otherwise(new(F.lit(False), acc["out"]))
        )

    full = rf"^#?([{_LETTER}0-9][\p{{L}}\p{{N}}_/-]*)$"
    bare = lambda w: F.regexp_replace(w, "^['\"]+|['\"]+$", "")

    def words(r):
        each = F.transform(F.split(r["raw"], rf"[,{T.SPACE}]+"), lambda w, i: F.struct(r["line"].alias("line"), i.cast("int").alias("seq"), bare(w).alias("tag")))
        return F.transform(F.filter(each, lambda x: x["tag"].rlike(full)), lambda x: F.struct(x["line"].alias("line"), x["seq"].alias("seq"), F.concat(F.lit("#"), F.regexp_extract(x["tag"], full, 1)).alias("tag")))

    return F.flatten(F.transform(F.aggregate(fm, start, step, lambda acc: acc["out"]), words))


def sections(notes: DataFrame) -> DataFrame:
    """path, line, heading, last_line: each heading's section up to the next heading of its level or above
    (null: the end). From a note's end backwards, the nearest heading of each level so far."""
    later = Window.partitionBy("path").orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, -1)
    nearest = [F.when(F.col("level") >= k, F.min(F.when(F.col("level") == k, F.col("line"))).over(later)) for k in range(1, 7)]
    return headings(notes).select("path", "line", "heading", (F.least(*nearest) - 1).alias("last_line"))


def read_section(notes: DataFrame, section: str) -> DataFrame:
    """path, section_text of the first heading with that text in each note that has it."""
    key = section.strip().lower()
    chosen = sections(notes).filter(F.lower(T.strip(F.col("heading"))) == key).groupBy("path").agg(F.min(F.struct("line", "last_line")).alias("s"))
    joined = notes.join(chosen, "path")
    ls = T.lines(F.col("text"))
    count = F.coalesce(F.col("s.last_line"), F.size(ls)) - F.col("s.line") + 1
    return joined.select("path", F.array_join(F.slice(ls, F.col("s.line"), F.greatest(count, F.lit(0))), "\n").alias("section_text"))


def truncated(text: Column, limit: int) -> Column:
    """At most limit characters; where some are cut, white space at the cut goes and a mark follows."""
    cut = F.concat(F.regexp_replace(F.substring(text, 1, limit), rf"[{T.SPACE}]+$", ""), F.lit("\n...[truncated]"))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def without_frontmatter(text: Column) -> Column:
    """Cut after the closing delimiter and following line feeds; unchanged where it isn't closed."""
    return F.regexp_replace(text, rf"(?s)\A---\n(?:.*?\n)??[{T.SPACE}&&[^\n]]*---[{T.SPACE}&&[^\n]]*(?:\n+|\z)", "")


def umbrella_document() -> Column:
    """umbrella_like of a search document's columns title, headings, tags, tasks and body."""
    text = F.concat_ws("\n", *[F.when(F.col(c) != "", F.col(c)) for c in ("title", "headings", "tags", "tasks", "body")])
    rows = F.filter(F.transform(T.lines(F.col("body")), T.strip), lambda x: (x != "") & ~x.startswith("#"))
    is_link = lambda x: (x.rlike(r"^[-*+]") & x.contains("[[")) | x.rlike(r"^\[\[[^\]]+\]\]$")
    links, prose = F.size(F.filter(rows, is_link)), F.size(F.filter(rows, lambda x: ~is_link(x)))
    return text.contains("[[") & (prose <= 1) & (links >= 1) & (F.size(T.tokens(text)) <= 20)


def search_docs(notes: DataFrame) -> DataFrame:
    """path, path_text, title (the file's stem), headings, tags, tasks, body: each note's facts where they are."""
    parsed = notes if PARSED[0] in notes.columns else parse(notes.select("path", "text"))
    joined = lambda column, value, by: F.array_join(F.transform(column, lambda x: x[value]), by)
    return parsed.select(
        "path", F.col("path").alias("path_text"), T.stem(F.col("path")).alias("title"),
        joined(PARSED[0], "heading", "\n").alias("headings"), joined(PARSED[3], "tag", " ").alias("tags"), joined(PARSED[1], "task", "\n").alias("tasks"),
        F.col("text").alias("body"),
    )
