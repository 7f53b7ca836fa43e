"""The same queries in plain SQL, for a second engine on the same tables. Written apart from the plans: lines,
facts and links are derived with unnest, windows and joins."""

from __future__ import annotations

from quillgraph.functions.folding import FROM, MARKS, TO
from quillgraph.operators.duplicates import STOPWORDS
from quillgraph.plans.corpus import NOTES_SQL
from quillgraph.plans.queries import LIMIT_CHARS, QUERY, SECTION

_SQ = lambda s: "'" + s.replace("'", "''") + "'"

#: Common tables by name, each with the names that it needs.
CTE: dict[str, tuple[str, str]] = {
    "notes": ("", NOTES_SQL.format(documents="documents")),
    "raw_lines": ("notes", "SELECT path, CAST(unnest(range(1, len(ls) + 1)) AS INT) AS line, unnest(ls) AS text FROM (SELECT path, CASE WHEN ends_with(text, chr(10)) THEN string_split(text[:-2], chr(10)) ELSE string_split(text, chr(10)) END AS ls FROM notes)"),
    "fm": ("raw_lines", "SELECT a.path, min(b.line) AS fm_end FROM raw_lines a JOIN raw_lines b ON a.path = b.path AND b.line > 1 AND regexp_matches(b.text, '^---\\s*$') WHERE a.line = 1 AND regexp_matches(a.text, '^---\\s*$') GROUP BY a.path"),
    "marked": ("raw_lines fm", "SELECT r.path, r.line, r.text, coalesce(f.fm_end, 0) AS fm_end, r.line > coalesce(f.fm_end, 0) AND regexp_matches(r.text, '^\\s*(```|~~~)') AS fence FROM raw_lines r LEFT JOIN fm f ON r.path = f.path"),
    "body": ("marked", "SELECT path, line, text FROM (SELECT *, sum(CAST(fence AS INT)) OVER (PARTITION BY path ORDER BY line) AS seen FROM marked) WHERE line > fm_end AND NOT fence AND seen % 2 = 0"),
    "heads": ("body", "SELECT path, line, CAST(length(regexp_extract(text, '^(#{1,6})\\s+(.+?)\\s*#*\\s*$', 1)) AS INT) AS level, trim(regexp_extract(text, '^(#{1,6})\\s+(.+?)\\s*#*\\s*$', 2), ' ' || chr(9)) AS heading FROM body WHERE regexp_matches(text, '^(#{1,6})\\s+(.+?)\\s*#*\\s*$')"),
    "todo": ("body", "SELECT path, line, lower(regexp_extract(text, '^\\s*[-*]\\s+\\[([ xX])\\]\\s+(.*)$', 1)) = 'x' AS done, trim(regexp_extract(text, '^\\s*[-*]\\s+\\[([ xX])\\]\\s+(.*)$', 2)) AS task FROM body WHERE regexp_matches(text, '^\\s*[-*]\\s+\\[([ xX])\\]\\s+(.*)$')"),
    "rawlinks": ("body", "SELECT path, line, CAST(unnest(range(0, len(l))) AS INT) AS seq, unnest(l) AS raw FROM (SELECT path, line, regexp_extract_all(text, '(?:^|[^!])\\[\\[([^\\]\\n]+)\\]\\]', 1) AS l FROM body)"),
    "wl": ("rawlinks", "SELECT path, line, seq, trim(string_split(string_split(trim(raw), '|')[1], '#')[1]) AS target, CASE WHEN contains(raw, '|') THEN trim(substr(trim(raw), strpos(trim(raw), '|') + 1)) END AS alias FROM rawlinks"),
    "fmlines": ("marked", "SELECT path, line, trim(text) AS s FROM marked WHERE line > 1 AND line < fm_end"),
    "meta": ("fmlines", "SELECT path, key, trim(unnest(CASE WHEN starts_with(v, '[') THEN string_split(v[2:-2], ',') ELSE [v] END)) AS value FROM (SELECT path, trim(s[:strpos(s, ':') - 1]) AS key, trim(s[strpos(s, ':') + 1:]) AS v FROM fmlines WHERE contains(s, ':'))"),
    "tg": (
        "fmlines body",
        "SELECT path, line, '#' || trim(unnest(string_split(regexp_extract(s, '^tags:\\s*\\[(.*)\\]$', 1), ','))) AS tag FROM fmlines WHERE starts_with(s, 'tags: [') "
        "UNION ALL SELECT path, line, '#' || unnest(regexp_extract_all(text, '(?:^|[^\\p{L}\\p{N}_/-])#([A-Za-zА-Яа-я0-9][\\p{L}\\p{N}_/-]*)', 1)) AS tag FROM body",
    ),
    "paths": ("notes", "SELECT path, mtime, doc_id, text, regexp_extract(path, '([^/]*)\\.md$', 1) AS stem, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, string_split(path, '/') AS parts, CASE split_part(path, '/', 1) WHEN 'Inbox' THEN 'inbox' WHEN 'Projects' THEN 'project' WHEN 'Areas' THEN 'area' WHEN 'Resources' THEN 'resource' END AS role FROM notes"),
    "stems": ("paths", "SELECT lower(stem) AS k, list_sort(list(path)) AS cands FROM paths GROUP BY 1"),
    "links": (
        "wl stems",
        "SELECT w.path, w.line, w.seq, w.target, CASE WHEN len(cands) = 1 THEN cands[1] END AS resolved_path, "
        "CASE WHEN len(cands) > 1 THEN (SELECT c FROM (SELECT unnest(cands) AS c) ORDER BY -(CASE WHEN split_part(c, '/', 1) <> split_part(w.path, '/', 1) THEN 0 ELSE len(list_filter(range(1, least(len(string_split(c, '/')), len(string_split(w.path, '/'))) + 1), lambda i: string_split(c, '/')[:i] = string_split(w.path, '/')[:i])) END), CASE WHEN split_part(c, '/', 1) = split_part(w.path, '/', 1) THEN 0 ELSE 1 END, c LIMIT 1) END AS preferred_path, "
        "CASE WHEN cands IS NULL THEN 'missing' WHEN len(cands) = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN len(cands) > 1 THEN cands END AS candidates "
        "FROM wl w LEFT JOIN stems s ON lower(w.target) = s.k",
    ),
    "back": ("links", "SELECT resolved_path AS path, path AS source, line FROM links WHERE resolved_path IS NOT NULL UNION ALL SELECT preferred_path, path, line FROM links WHERE preferred_path IS NOT NULL"),
    "deg": ("paths links back", "SELECT p.path, coalesce(o.n, 0) AS out_links, coalesce(b.n, 0) AS back_links FROM paths p LEFT JOIN (SELECT path, count(*) AS n FROM links GROUP BY 1) o ON p.path = o.path LEFT JOIN (SELECT path, count(*) AS n FROM back GROUP BY 1) b ON p.path = b.path"),
    "roles": ("paths meta", "SELECT p.path, coalesce(m.v, 'source') AS role FROM paths p LEFT JOIN (SELECT path, min(lower(value)) AS v FROM meta WHERE key = 'note_role' AND lower(value) IN ('source', 'umbrella') GROUP BY 1) m ON p.path = m.path"),
    "fileset": ("paths", "SELECT path, doc_id, mtime, text, CAST(octet_length(encode(text)) AS INT) AS size_bytes, sha256(text) AS sha256 FROM paths"),
    "groups": ("fileset", "SELECT sha256, count(*) AS n, list_sort(list(path)) AS members FROM fileset GROUP BY 1 HAVING count(*) > 1"),
    "assess": (
        "fileset groups deg paths",
        "SELECT f.path, f.sha256, CAST(coalesce(p.role, '') <> 'inbox' AS INT) AS not_inbox, d.out_links + d.back_links AS conn, d.out_links, d.back_links, f.mtime, CASE p.role WHEN 'inbox' THEN 2 WHEN 'project' THEN 4 WHEN 'area' THEN 4 WHEN 'resource' THEN 4 ELSE 3 END AS rank, p.role, greatest(20 - len(p.parts), 0) AS short "
        "FROM fileset f JOIN groups g ON f.sha256 = g.sha256 JOIN deg d ON f.path = d.path JOIN paths p ON f.path = p.path",
    ),
    "elected": ("assess", "SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY not_inbox DESC, conn DESC, mtime DESC, rank DESC, short DESC, path DESC) AS place FROM assess"),
    "canon": ("elected", "SELECT e.path, c.path AS canonical_path FROM elected e JOIN elected c ON e.sha256 = c.sha256 AND c.place = 1"),
    "sdocs": (
        "paths heads tg todo",
        "SELECT p.path, p.path AS path_text, p.stem AS title, coalesce(h.v, '') AS headings, coalesce(t.v, '') AS tags, coalesce(k.v, '') AS tasks, p.text AS body FROM paths p "
        "LEFT JOIN (SELECT path, string_agg(heading, chr(10) ORDER BY line) AS v FROM heads GROUP BY 1) h ON p.path = h.path "
        "LEFT JOIN (SELECT path, string_agg(tag, ' ' ORDER BY line) AS v FROM tg GROUP BY 1) t ON p.path = t.path "
        "LEFT JOIN (SELECT path, string_agg(task, chr(10) ORDER BY line) AS v FROM todo GROUP BY 1) k ON p.path = k.path",
    ),
    "umb": (
        "sdocs",
        "SELECT path, contains(t, '[[') AND len(list_filter(rows, lambda x: NOT link(x))) <= 1 AND len(list_filter(rows, lambda x: link(x))) >= 1 AND len(regexp_extract_all(t, '[\\p{L}\\p{N}]+')) <= 20 AS umbrella_like FROM (SELECT path, concat_ws(chr(10), nullif(title, ''), nullif(headings, ''), nullif(tags, ''), nullif(tasks, ''), nullif(body, '')) AS t, list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT starts_with(x, '#')) AS rows FROM sdocs)".replace("NOT link(x)", "NOT ((regexp_matches(x, '^[-*+]') AND contains(x, '[[')) OR regexp_full_match(x, '\\[\\[[^\\]]+\\]\\]'))").replace("link(x)", "(regexp_matches(x, '^[-*+]') AND contains(x, '[[')) OR regexp_full_match(x, '\\[\\[[^\\]]+\\]\\]')"),
    ),
    "ptitle": ("paths", "SELECT path, trim(regexp_extract(text, '(?m)^#{1,6}\\s+(.+?)\\s*#*\\s*$', 1), ' ' || chr(9) || chr(10)) AS title FROM paths"),
    "tkeys": ("ptitle", "SELECT path, array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(title, '[\\p{L}\\p{N}]+'), lambda x: length(x) > 2), lambda x: replace(lower(x), 'ß', 'ss')))), ' ') AS title_key FROM ptitle"),
    "cur": ("fileset", "SELECT path, size_bytes, mtime, sha256 FROM fileset WHERE doc_id % 19 <> 0"),
    "prev": ("fileset", "SELECT path, CAST(octet_length(encode(t)) AS INT) AS size_bytes, mtime, sha256(t) AS sha256 FROM (SELECT path, mtime, CASE WHEN doc_id % 17 = 0 THEN text || 'x' ELSE text END AS t FROM fileset WHERE doc_id % 13 <> 0)"),
    "delta": ("cur prev", "SELECT coalesce(c.path, p.path) AS path, CASE WHEN p.path IS NULL THEN 'new' WHEN c.path IS NULL THEN 'deleted' WHEN c.size_bytes = p.size_bytes AND c.mtime = p.mtime THEN 'unchanged' ELSE 'changed' END AS change, c.path IS NOT NULL AND (p.path IS NULL OR ((c.size_bytes <> p.size_bytes OR c.mtime <> p.mtime) AND c.sha256 <> p.sha256)) AS reparse FROM cur c FULL JOIN prev p ON c.path = p.path"),
    "anc": ("paths", "SELECT path, array_to_string(dirs[:n], '/') || '/' AS ancestor, CAST(n - 1 AS INT) AS depth FROM (SELECT path, string_split(parent, '/') AS dirs, unnest(range(2, len(string_split(parent, '/')) + 1)) AS n FROM paths WHERE split_part(path, '/', 1) IN ('Projects', 'Areas', 'Resources'))"),
    "prof": (
        "paths",
        "SELECT role, path, CASE WHEN role = 'inbox' OR NOT nested_any THEN root ELSE root || split_part(rest, '/', 1) || CASE WHEN contains(rest, '/') THEN '/' ELSE '' END END AS profile FROM (SELECT role, path, parts[1] || '/' AS root, path[length(parts[1]) + 2:] AS rest, bool_or(len(parts) > 2) OVER (PARTITION BY parts[1]) AS nested_any FROM paths WHERE role IS NOT NULL)",
    ),
    "sterms": (
        "sdocs",
        "SELECT DISTINCT path, term FROM (SELECT path, replace(lower(unnest(regexp_extract_all(regexp_replace(t, '(?i)(?:https?://|www\\.)\\S+', ' ', 'g'), '[\\p{L}\\p{N}]+'))), 'ß', 'ss') AS term FROM (SELECT path, concat_ws(chr(10), title, headings, tags, tasks) AS t FROM sdocs)) WHERE length(term) > 2 AND regexp_matches(term, '\\p{L}') AND term NOT IN (" + ", ".join(map(_SQ, STOPWORDS)) + ")",
    ),
    "sidf": ("sterms", "SELECT term, count(*) AS df, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) + 1 AS idf FROM sterms GROUP BY 1"),
    "skept": ("sterms sidf", "SELECT s.path, s.term, i.idf FROM sterms s JOIN sidf i ON s.term = i.term WHERE i.df <= greatest(5, ceil((SELECT count(DISTINCT path) FROM sterms) * 0.10))"),
    "snorm": ("skept", "SELECT path, sum(idf * idf) AS norm, count(*) AS size FROM skept GROUP BY 1"),
    "cosine": ("skept snorm", "SELECT d.a AS path_a, d.b AS path_b, d.shared, na.size AS size_a, nb.size AS size_b, d.dot / sqrt(na.norm * nb.norm) AS cosine FROM (SELECT x.path AS a, y.path AS b, count(*) AS shared, sum(x.idf * x.idf) AS dot FROM skept x JOIN skept y ON x.term = y.term AND x.path < y.path GROUP BY 1, 2) d JOIN snorm na ON d.a = na.path JOIN snorm nb ON d.b = nb.path"),
    "post": (
        "sdocs",
        "SELECT path, col, unnest(range(0, len(ts))) AS pos, unnest(ts) AS term FROM (SELECT path, col, regexp_extract_all(translate(lower(t), " + _SQ(FROM + MARKS) + ", " + _SQ(TO) + "), '[\\p{L}\\p{N}]+') AS ts FROM (SELECT path, 0 AS col, path_text AS t FROM sdocs UNION ALL SELECT path, 1, title FROM sdocs UNION ALL SELECT path, 2, headings FROM sdocs UNION ALL SELECT path, 3, tags FROM sdocs UNION ALL SELECT path, 4, tasks FROM sdocs UNION ALL SELECT path, 5, body FROM sdocs))",
    ),
    "drafts": ("", "SELECT item_id AS draft_id, text AS content FROM benchmark"),
    "dtitle": ("drafts", "SELECT draft_id, content, substr(trim(x), 1, 80) AS title FROM (SELECT draft_id, content, list_filter(string_split(content, chr(10)), lambda s: trim(s) <> '')[1] AS x FROM drafts)"),
    "dterms": ("dtitle", "SELECT draft_id, list_distinct(list_transform(list_filter(regexp_extract_all(content, '[\\p{L}\\p{N}]+'), lambda x: length(x) > 2), lambda x: replace(lower(x), 'ß', 'ss'))) AS terms, array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(title, '[\\p{L}\\p{N}]+'), lambda x: length(x) > 2), lambda x: replace(lower(x), 'ß', 'ss')))), ' ') AS key FROM dtitle"),
    "nterms": ("sdocs", "SELECT path, list_distinct(list_transform(list_filter(regexp_extract_all(concat_ws(' ', path_text, title, headings, tags, tasks, body), '[\\p{L}\\p{N}]+'), lambda x: length(x) > 2), lambda x: replace(lower(x), 'ß', 'ss'))) AS terms, title FROM sdocs"),
}


def sql(final: str) -> str:
    """final with the common tables that it names, and theirs, before it."""
    order: list[str] = []

    def need(name: str) -> None:
        if name not in order:
            for x in CTE[name][0].split():
                need(x)
            order.append(name)

    words = set(final.replace("(", " ").replace(")", " ").replace(",", " ").split())
    for name in CTE:
        if name in words:
            need(name)
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n][1].strip()})" for n in order) + "\n" + final


_TERMS = "list_distinct(list_transform(list_filter(regexp_extract_all({}, '[\\p{{L}}\\p{{N}}]+'), lambda x: length(x) > 2), lambda x: replace(lower(x), 'ß', 'ss')))"
_FINDINGS = (
    "SELECT 'missing_para_directory' AS type, 'high' AS severity, dir AS path, dir AS summary FROM (SELECT unnest(['Inbox/', 'Projects/', 'Areas/', 'Resources/', 'Archive/']) AS dir EXCEPT SELECT parts[1] || '/' FROM paths WHERE lower(parts[1]) NOT IN ('archive', 'archives') ) UNION ALL "
    "SELECT 'exact_duplicate' AS type, 'medium' AS severity, path, substr(sha256, 1, 12) AS summary FROM elected WHERE place = 1 "
    "UNION ALL SELECT 'ambiguous_wikilink', 'medium', path, target FROM links WHERE status = 'ambiguous' "
    "UNION ALL SELECT 'missing_wikilink', 'medium', path, target FROM links WHERE status = 'missing' "
    "UNION ALL SELECT 'invalid_role_marker', 'medium', path, string_agg(DISTINCT lower(value), ', ' ORDER BY lower(value)) FROM meta WHERE key = 'note_role' AND lower(value) NOT IN ('source', 'umbrella') GROUP BY path "
    "UNION ALL SELECT 'missing_role_marker', CASE WHEN umbrella_like THEN 'medium' ELSE 'low' END, path, CASE WHEN umbrella_like THEN 'umbrella' ELSE 'source' END FROM umb WHERE path NOT IN ( SELECT path FROM meta WHERE key = 'note_role' )"
)

_ROUTE = "SELECT draft_id, destination, score FROM (WITH q AS (SELECT draft_id, unnest(terms) AS term FROM dterms ), nt AS (SELECT path, unnest(list_distinct(list_transform(list_filter(regexp_extract_all(concat_ws(' ', title, headings, tags, tasks, body), '[\\p{L}\\p{N}]+'), lambda x: length(x) > 2), lambda x: replace(lower(x), 'ß', 'ss')))) AS term FROM sdocs ), df AS (SELECT term, count(*) AS n FROM nt GROUP BY 1), w AS (SELECT q.draft_id, q.term, ln(((SELECT count(*) FROM sdocs ) + 1) / (coalesce(df.n, 0) + 1)) + 1 AS w FROM q LEFT JOIN df ON q.term = df.term), m AS (SELECT draft_id, sum(w) AS mass FROM w GROUP BY 1), e AS (SELECT w.draft_id, nt.path, round(sum(w.w) / any_value(m.mass), 12) AS e FROM nt JOIN w ON nt.term = w.term JOIN m ON w.draft_id = m.draft_id GROUP BY 1, 2 HAVING count(*) >= 2), b AS (SELECT e.draft_id, anc.ancestor, anc.depth, e.e, row_number() OVER (PARTITION BY e.draft_id, anc.ancestor ORDER BY e.e DESC, e.path DESC) AS r FROM e JOIN anc ON e.path = anc.path), s AS (SELECT draft_id, ancestor, CAST(round_even(round((sum(CASE WHEN r = 1 THEN e ELSE e * 0.25 END) + least(any_value(depth), 3) * 0.03) * 100, 9), 0) AS INT) AS score FROM b WHERE r <= 3 GROUP BY 1, 2), k AS (SELECT * FROM s WHERE score >= THRESHOLD) SELECT draft_id, ancestor AS destination, score FROM k x WHERE NOT EXISTS (SELECT 1 FROM k y WHERE y.draft_id = x.draft_id AND y.ancestor <> x.ancestor AND starts_with(y.ancestor, x.ancestor) AND y.score >= x.score * 0.8) UNION ALL SELECT draft_id, 'Inbox/', 5 FROM drafts )"
_RANKED = "SELECT draft_id, rank, destination, score, CASE WHEN max(CASE WHEN rank = 1 AND destination <> 'Inbox/' AND score >= 35 THEN 1 ELSE 0 END) OVER (PARTITION BY draft_id) = 1 THEN 'high' ELSE 'low' END AS confidence FROM (SELECT draft_id, destination, score, CAST(row_number() OVER (PARTITION BY draft_id ORDER BY score DESC, len(string_split(rtrim(destination, '/'), '/')) DESC, destination) AS INT) AS rank FROM (" + _ROUTE.replace("THRESHOLD", "35") + ') ) QUALIFY rank <= 5'

ORACLE_SQL: dict[str, str] = {
    k: sql(v)
    for k, v in {
        "folder_link_status": "SELECT split_part(path, '/', 1) AS folder, status, count(*) AS n FROM links GROUP BY 1, 2",
        "md_lines": "SELECT path, line, text FROM raw_lines",
        "md_outside_fences": "SELECT path, line, text FROM body",
        "headings": "SELECT path, line, level, heading FROM heads",
        "tasks": "SELECT path, line, done, task FROM todo",
        "wikilinks": "SELECT path, line, seq, target, alias FROM wl",
        "tags": "SELECT path, line, tag FROM tg",
        "frontmatter": "SELECT path, key, value FROM meta",
        "extract_title": "SELECT path, title FROM ptitle",
        "sections": "SELECT a.path, a.line, a.heading, CAST(min(b.line) - 1 AS INT) AS last_line FROM heads a LEFT JOIN heads b ON a.path = b.path AND b.line > a.line AND b.level <= a.level GROUP BY 1, 2, 3",
        "read_section": f"SELECT r.path, string_agg(r.text, chr(10) ORDER BY r.line) AS section_text FROM raw_lines r JOIN (SELECT a.path, a.line, min(b.line) AS stop FROM heads a LEFT JOIN heads b ON a.path = b.path AND b.line > a.line AND b.level <= a.level WHERE lower(a.heading) = '{SECTION}' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY a.path ORDER BY a.line) = 1) s ON r.path = s.path AND r.line >= s.line AND (s.stop IS NULL OR r.line < s.stop) GROUP BY 1",
        "read_truncated": f"SELECT path, CASE WHEN length(text) > {LIMIT_CHARS} THEN rtrim(substr(text, 1, {LIMIT_CHARS}), ' ' || chr(10) || chr(9)) || chr(10) || '...[truncated]' ELSE text END AS text FROM notes",
        "umbrella_like": "SELECT path, umbrella_like FROM umb",
        "path_role": "SELECT path, role FROM paths",
        "path_parts": "SELECT path, parent, stem || '.md' AS name, stem, '.md' AS suffix, CAST(len(parts) AS INT) AS parts FROM paths",
        "note_role": "SELECT path, role FROM roles",
        "role_missing": "SELECT path, CASE WHEN umbrella_like THEN 'umbrella' ELSE 'source' END AS role_hint FROM umb WHERE path NOT IN ( SELECT path FROM meta WHERE key = 'note_role' )",
        "role_invalid": "SELECT path, string_agg(DISTINCT lower(value), ', ' ORDER BY lower(value)) AS invalid_values FROM meta WHERE key = 'note_role' AND lower(value) NOT IN ('source', 'umbrella') GROUP BY path",
        "link_resolution": "SELECT path, line, seq, target, resolved_path, status, array_to_string(candidates, chr(10)) AS candidates FROM links",
        "preferred_link": "SELECT path, line, seq, preferred_path FROM links WHERE status = 'ambiguous'",
        "links_ambiguous": "SELECT path, line, target FROM links WHERE status = 'ambiguous'",
        "links_missing": "SELECT path, line, target FROM links WHERE status = 'missing'",
        "outgoing_links": "SELECT path, string_agg(DISTINCT x, chr(10) ORDER BY x) AS links FROM (SELECT path, coalesce(resolved_path, preferred_path, target) AS x FROM links ) GROUP BY 1",
        "backlinks": "SELECT path, source, line FROM back",
        "umbrella_backlinks": "SELECT DISTINCT b.path, b.source FROM back b JOIN roles r ON b.source = r.path WHERE r.role = 'umbrella'",
        "link_degrees": "SELECT path, out_links, back_links FROM deg",
        "shortest_links": "SELECT path, CASE WHEN count(*) OVER (PARTITION BY replace(lower(stem), 'ß', 'ss')) = 1 THEN '[[' || stem || ']]' ELSE '[[' || path[:-4] || ']]' END AS link FROM paths",
        "exact_dup_groups": "SELECT 'sha256:' || substr(g.sha256, 1, 12) AS group_id, g.n, array_to_string(g.members, chr(10)) AS paths, e.path AS canonical_path FROM groups g JOIN elected e ON g.sha256 = e.sha256 AND e.place = 1",
        "exact_dup_paths": "SELECT f.path, array_to_string(g.members, chr(10)) AS paths FROM fileset f JOIN groups g ON f.sha256 = g.sha256",
        "dup_examples": "SELECT sha256, n, array_to_string(members, chr(10)) AS paths FROM groups ORDER BY n DESC, sha256 LIMIT 10",
        "empty_directories": "SELECT 'empty_directory' AS type, CASE WHEN top IN ('Areas', 'Projects', 'Resources') THEN 'medium' ELSE 'low' END AS severity, path, CASE top WHEN 'Areas' THEN 'Empty area directory' WHEN 'Projects' THEN 'Empty project directory' WHEN 'Resources' THEN 'Empty resource directory' ELSE 'Empty unclassified directory' END AS summary "
        "FROM (SELECT path, split_part(path, '/', 1) AS top FROM (SELECT parent || '/' AS path FROM paths GROUP BY 1 HAVING count(*) FILTER (WHERE doc_id % 5 <> 0) = 0 UNION SELECT unnest(['Areas/none/', 'Misc/old/', 'Projects/P1/none/']))) WHERE path NOT IN ('Inbox/', 'Projects/', 'Areas/', 'Resources/', 'Archive/')",
        "dup_group_count": "SELECT count(*) AS groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS files FROM groups",
        "canonical_paths": "SELECT p.path, coalesce(c.canonical_path, p.path) AS canonical_path FROM paths p LEFT JOIN canon c ON p.path = c.path",
        "canonical_reasons": "SELECT w.path AS canonical_path, coalesce(nullif(concat_ws(chr(10), CASE WHEN w.not_inbox = 1 AND min(o.not_inbox) = 0 THEN 'preferred over inbox paths' END, CASE WHEN w.conn > max(o.conn) THEN 'most connected duplicate (' || w.back_links || ' backlinks, ' || w.out_links || ' outgoing links)' END, CASE WHEN w.mtime > max(o.mtime) THEN 'newest duplicate copy' END, CASE WHEN w.rank > max(o.rank) THEN 'stronger vault role (' || coalesce(w.role, 'unclassified') || ')' END, CASE WHEN (w.short, w.path) > max((o.short, o.path)) THEN 'shorter, more stable path tie-break' END), ''), 'stable lexical tie-break on path') AS reasons FROM elected w JOIN elected o ON w.sha256 = o.sha256 AND o.place > 1 WHERE w.place = 1 GROUP BY w.path, w.sha256, w.not_inbox, w.conn, w.back_links, w.out_links, w.mtime, w.rank, w.role, w.short",
        "index_info": "SELECT (SELECT count(*) FROM paths ) AS files, (SELECT count(*) FROM paths WHERE ends_with(lower(path), '.md')) AS markdown_files, count(*) AS dup_groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS dup_files FROM groups",
        "scan_delta": "SELECT path, change, reparse FROM delta",
        "scan_counters": "SELECT count(*) FILTER (change <> 'deleted') AS file_count, count(*) FILTER (change IN ('new', 'changed')) AS changed_count, count(*) FILTER (change = 'deleted') AS deleted_count, count(*) FILTER (change = 'unchanged') AS unchanged_count FROM delta",
        "index_drift": "SELECT change, n, coalesce(examples, '') AS examples FROM (SELECT CASE change WHEN 'new' THEN 'added' ELSE change END AS change, count(*) AS n, string_agg(path, chr(10) ORDER BY path) FILTER (r <= 10 AND change <> 'unchanged') AS examples FROM (SELECT *, row_number() OVER (PARTITION BY change ORDER BY path) AS r FROM delta ) GROUP BY 1)",
        "upsert_files": "SELECT path, size_bytes, mtime, sha256 FROM cur WHERE path IN (SELECT path FROM delta WHERE change IN ('new', 'changed')) UNION ALL SELECT path, size_bytes, mtime, sha256 FROM prev WHERE path IN (SELECT path FROM delta WHERE change = 'unchanged')",
        "cascade_delete": "SELECT path, line, heading FROM heads WHERE path NOT IN (SELECT path FROM delta WHERE change = 'deleted')",
        "doc_terms": f"SELECT path, unnest({_TERMS.format(chr(39).join(['concat_ws(', ' ', ', title, headings, tags)']))}) AS term FROM sdocs",
        "title_keys": "SELECT path, title_key FROM tkeys",
        "title_collisions": "SELECT title_key, count(*) AS n, min(path) AS first_path FROM tkeys WHERE title_key <> '' GROUP BY 1 HAVING count(*) > 1",
        "term_idf": "SELECT term, df, round(idf, 6) AS idf FROM sidf",
        "tfidf_cosine": "SELECT path_a, path_b, shared, round(cosine, 6) AS cosine FROM cosine WHERE shared >= 2",
        "semantic_candidates": "SELECT path_a, path_b, CAST(round_even(round(cosine * 100, 6), 0) AS INT) AS score FROM cosine WHERE least(size_a, size_b) >= 6 AND shared >= 2 AND round(cosine, 9) >= 0.55 AND regexp_extract(path_a, '^(.*)/', 1) <> regexp_extract(path_b, '^(.*)/', 1)",
        "name_similarity": "SELECT a.path AS path_a, b.path AS path_b, round(greatest(len(list_intersect(a.w, b.w)) / len(a.w), len(list_intersect(a.w, b.w)) / len(b.w)), 6) AS similarity FROM (SELECT path, parent, list_distinct(list_filter(regexp_extract_all(lower(stem), '[\\p{L}\\p{N}]+'), lambda x: regexp_matches(x, '\\p{L}'))) AS w FROM paths ) a JOIN (SELECT path, parent, list_distinct(list_filter(regexp_extract_all(lower(stem), '[\\p{L}\\p{N}]+'), lambda x: regexp_matches(x, '\\p{L}'))) AS w FROM paths ) b ON a.parent = b.parent AND a.path < b.path WHERE greatest(len(list_intersect(a.w, b.w)) / len(a.w), len(list_intersect(a.w, b.w)) / len(b.w)) >= 0.85",
        "search_bm25": "SELECT path, round(-sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / (total / n_docs)))), 6) AS score FROM (SELECT f.path, f.f, l.d, c.n_docs, c.total, CASE WHEN ln((c.n_docs - count(*) OVER (PARTITION BY f.term) + 0.5) / (count(*) OVER (PARTITION BY f.term) + 0.5)) <= 0 THEN 1e-6 ELSE ln((c.n_docs - count(*) OVER (PARTITION BY f.term) + 0.5) / (count(*) OVER (PARTITION BY f.term) + 0.5)) END AS idf FROM (SELECT path, term, count(*) AS f FROM post WHERE term IN (" + ", ".join(map(_SQ, QUERY.split())) + ") GROUP BY 1, 2) f JOIN (SELECT path, count(*) AS d FROM post GROUP BY 1) l ON f.path = l.path, (SELECT count(DISTINCT path) AS n_docs, count(*) AS total FROM post ) c) GROUP BY path HAVING count(*) = " + str(len(QUERY.split())) + " ORDER BY score, path LIMIT 10",
        "inspect": "SELECT f.path, f.size_bytes, r.role, d.out_links, d.back_links, (SELECT count(*) FROM heads h WHERE h.path = f.path) AS n_headings, (SELECT count(DISTINCT tag) FROM tg t WHERE t.path = f.path) AS n_tags, (SELECT count(*) FROM todo k WHERE k.path = f.path) AS n_tasks, coalesce(c.canonical_path, f.path) AS canonical_path FROM fileset f JOIN roles r ON f.path = r.path JOIN deg d ON f.path = d.path LEFT JOIN canon c ON f.path = c.path",
        "find_duplicates": "SELECT draft_id, path, score FROM (SELECT draft_id, path, CAST(score AS BIGINT) AS score, row_number() OVER (PARTITION BY draft_id ORDER BY score DESC, path) AS r FROM (SELECT d.draft_id, n.path, least(60, CAST(round_even(len(list_intersect(d.terms, n.terms)) / greatest(1, least(len(d.terms), len(n.terms))) * 100, 0) AS INT)) + CASE WHEN d.key <> '' AND d.key = array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(n.title, '[\\p{L}\\p{N}]+'), lambda x: length(x) > 2), lambda x: lower(x)))), ' ') THEN 70 ELSE 0 END + CASE WHEN d.key <> '' AND d.key = lower(n.title) THEN 50 ELSE 0 END AS score FROM dterms d, nterms n) WHERE score >= 20) WHERE r <= 5",
        "para_ancestors": "SELECT path, ancestor, depth FROM anc",
        "structure_profiles": "SELECT role, profile, count(*) AS note_count, string_agg(path, chr(10) ORDER BY path) FILTER (r <= 5) AS representatives FROM (SELECT *, row_number() OVER (PARTITION BY role, profile ORDER BY path) AS r FROM prof ) GROUP BY 1, 2",
        "profile_top_tags": "SELECT profile, tag, n, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY n DESC, tag) AS rank FROM (SELECT p.profile, t.tag, count(*) AS n FROM prof p JOIN tg t ON p.path = t.path GROUP BY 1, 2)) WHERE rank <= 5",
        "profile_top_terms": "SELECT profile, term, n, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY n DESC, term) AS rank FROM (SELECT p.profile, t.term, count(*) AS n FROM prof p JOIN (SELECT DISTINCT path, lower(w) AS term FROM (SELECT path, unnest(regexp_extract_all(concat_ws(' ', path_text, title, headings, tags), '[\\p{L}\\p{N}]+')) AS w FROM sdocs ) WHERE length(w) > 2) t ON p.path = t.path GROUP BY 1, 2)) WHERE rank <= 8",
        "layout_missing": "SELECT unnest(['Inbox/', 'Projects/', 'Areas/', 'Resources/', 'Archive/']) AS dir EXCEPT SELECT parts[1] || '/' FROM paths WHERE lower(parts[1]) NOT IN ('archive', 'archives')",
        "dir_source_counts": "SELECT array_to_string(dirs[:k], '/') || '/' AS dir, count(*) FILTER (k = len(dirs)) AS direct_count, count(*) AS total_count FROM (SELECT string_split(parent, '/') AS dirs, unnest(range(1, len(string_split(parent, '/')) + 1)) AS k FROM paths ) GROUP BY 1",
        "maintenance_report": _FINDINGS,
        "finding_counts": f"SELECT type, severity, count(*) AS n FROM ({_FINDINGS}) GROUP BY 1, 2",
        "route": _ROUTE.replace("THRESHOLD", "10"),
        "route_ranked": _RANKED,
        "index_refresh": "SELECT c.path, c.size_bytes, c.sha256, coalesce(h.n, 0) AS n_headings, coalesce(l.n, 0) AS n_links FROM cur c LEFT JOIN (SELECT path, count(*) AS n FROM heads GROUP BY 1) h ON h.path = c.path LEFT JOIN (SELECT path, count(*) AS n FROM links GROUP BY 1) l ON l.path = c.path",
        "index_meta": "SELECT CAST(2 AS BIGINT) AS version, CAST(1 AS BIGINT) AS previous, count(*) FILTER (change <> 'deleted') AS file_count, count(*) FILTER (change IN ('new', 'changed')) AS changed_count, count(*) FILTER (change = 'deleted') AS deleted_count, count(*) FILTER (change = 'unchanged') AS unchanged_count FROM delta",
    }.items()
}
