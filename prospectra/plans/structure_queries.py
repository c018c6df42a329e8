"""Document structure over one prospectus per supplier, whose pages are derived from its key."""

from __future__ import annotations

from pyspark.sql import functions as F

from prospectra.functions import fixed_values as V
from prospectra.operators import chunking, evidence as E, structure as S
from prospectra.plans.chunk_queries import PAGES_SQL, _atoms_sql, document_pages  # noqa: F401
from prospectra.plans.inputs import check_sql, derived, spread, table
from prospectra.plans.registry import Registry, shared
from prospectra.plans.text_queries import SECTION_KEY_SQL

TITLES = ("SECTION I – GENERAL", "DEFINITIONS AND ABBREVIATIONS", "SECTION II: RISK FACTORS", "SUMMARY OF FINANCIAL INFORMATION",
          "CAPITAL STRUCTURE", "OBJECTS OF THE OFFER", "SECTION III – ABOUT US", "OUR BUSINESS", "OUR PROMOTERS AND PROMOTER GROUP",
          "SECTION IV - LEGAL AND OTHER INFORMATION", "OUTSTANDING LITIGATION AND MATERIAL DEVELOPMENTS", "GOVERNMENT AND OTHER APPROVALS")
NL = "chr(10)"


def title_sql(i: int) -> str:
    base = "'" + TITLES[i] + "'"
    return f"CASE WHEN doc_id % 13 = 7 THEN 'OBJECTIVES' ELSE {base} END" if i == 5 else base


def _entry_sql(i: int) -> str:
    """One contents line (two for the wrapped title)."""
    dots = f"CASE WHEN doc_id % 2 = 1 THEN ' ……………… ' ELSE ' .......... ' END || '{1 + 3 * i}' || {NL}"
    if i == 10:
        return f"'OUTSTANDING LITIGATION AND' || {NL} || '  MATERIAL DEVELOPMENTS' || {dots}"
    lead = f"'This page lists the chapters' || {NL} || " if i == 3 else ""
    return f"{lead}{title_sql(i)} || {dots}"


_HEAD = (f"CASE WHEN doc_id % 17 = 9 THEN 'INDEX' WHEN doc_id % 7 = 2 THEN ' Contents ' ELSE 'TABLE OF CONTENTS' END || {NL} || {NL} || ")
_TOC1 = _HEAD + " || ".join(_entry_sql(i) for i in range(4)) + " || CASE WHEN doc_id % 11 = 4 THEN '' ELSE " + " || ".join(_entry_sql(i) for i in range(4, 8)) + " END"
_TOC2 = "CASE WHEN doc_id % 11 = 4 THEN 'nothing listed' ELSE " + " || ".join(_entry_sql(i) for i in range(8, 12)) + " END"
_PR = "(p - 4 - CAST(doc_id % 4 AS INT))"
_TITLE_AT = " ".join(f"WHEN {_PR} = {1 + 3 * i} THEN {title_sql(i)}" for i in range(12))
_TITLE_LINE = (f"CASE WHEN doc_id % 5 = 1 AND {_PR} = 14 THEN 'CAPITAL  STRUCTURE' WHEN doc_id % 5 = 2 AND {_PR} = 20 THEN 'Our Business' "
               f"WHEN (doc_id % 5 = 1 AND {_PR} = 13) OR (doc_id % 5 = 2 AND {_PR} = 22) OR (doc_id % 5 = 3 AND {_PR} = 25) THEN 'Continued' "
               f"{_TITLE_AT} ELSE 'Continued text' END")
_BODY = (f"'Body of the page for number ' || CAST(doc_id AS STRING) || ' and page mark ' || CAST({_PR} * 7 AS STRING) || '. ' "
         f"|| repeat('More words follow here, with nothing special. ', CAST((doc_id + p) % 30 AS INT)) "
         f"|| CASE WHEN {_PR} = 14 AND doc_id % 3 = 0 THEN {NL} || 'It is confirmed that none of the Equity Shares held by our Promoters' || {NL} || 'on the date of this document is pledged or encumbered.' ELSE '' END "
         f"|| CASE WHEN {_PR} = 35 AND doc_id % 2 = 0 THEN {NL} || 'Licences applied for and pending' WHEN {_PR} = 36 AND doc_id % 3 = 1 THEN {NL} || 'A consent has Expired' ELSE '' END")
_FOOT = (f"CASE WHEN doc_id % 9 = 5 THEN {NL} || CAST({_PR} - 1 AS STRING) ELSE '' END || {NL} || '2025' || {NL} || "
         f"CASE WHEN {_PR} < 1 OR doc_id % 19 = 6 THEN '' WHEN doc_id % 2 = 1 THEN 'Page | ' || CAST({_PR} AS STRING) ELSE CAST({_PR} AS STRING) END")
PAGE_TEXT = (f"CASE WHEN p = 0 THEN 'Cover of ' || CAST(doc_id AS STRING) || {NL} || '2025' WHEN p = 1 THEN {_TOC1} WHEN p = 2 THEN {_TOC2} "
             f"WHEN p = 3 THEN 'Notes' ELSE {_TITLE_LINE} || {NL} || {_BODY} || {_FOOT} END")
PROSPECTUS_SQL = f"""pages_ AS (SELECT doc_id, p, {PAGE_TEXT} AS text FROM (
  SELECT s_suppkey AS doc_id, CAST(unnest(generate_series(0, 43 + s_suppkey % 3)) AS INT) AS p FROM supplier))"""

# numbered bold headings and their neighbours, by position j
LINE_TEXT = """CASE j % 8 WHEN 0 THEN CAST(1 + (j DIV 8) * (1 + doc_id % 4) AS STRING) || CASE j DIV 8 % 4 WHEN 0 THEN '. Our revenue depends on' WHEN 1 THEN '.'
    WHEN 2 THEN '.“The use of' ELSE ') Heading of' END
  WHEN 1 THEN 'few customers and' WHEN 2 THEN 'may fall' WHEN 3 THEN 'Body text of 1.5 million' WHEN 4 THEN '1.5 million shares' WHEN 5 THEN
    CASE doc_id % 3 WHEN 0 THEN 'INTERNAL RISK FACTORS:' WHEN 1 THEN 'External risks ' ELSE 'inherent risks.' END WHEN 6 THEN 'plain line' ELSE 'Section risks' END"""
LINE_BOLD = "(j % 8 IN (0, 1, 4, 5, 7) OR (j % 8 = 2 AND doc_id % 2 = 0))"


@shared
def prospectuses(spark, sf):
    """One row per supplier with its page texts in order."""
    return spread(table(spark, sf, "supplier").selectExpr("s_suppkey AS doc_id"), "doc_id").selectExpr(
        "doc_id", f"transform(sequence(0, 43 + CAST(doc_id % 3 AS INT)), p -> {PAGE_TEXT}) AS pages")


@shared
def parsed(spark, sf):
    return S.parse_sections(prospectuses(spark, sf))


TITLE_NAME = r"upper(trim(regexp_replace(translate(regexp_replace({t}, '^SECTION\s+[IVXL]+\s*[-–—:]?\s*', '', 'i'), '’‘–—', '''''--'), '\s+', ' ', 'g')))"
HEADING_SQL = r"(length(regexp_replace({x}, '[^\p{{L}}]', '', 'g')) >= 3 AND length(regexp_replace({x}, '[^\p{{Lu}}]', '', 'g')) > 0.8 * length(regexp_replace({x}, '[^\p{{L}}]', '', 'g')))"
SECTIONS_SQL = rf"""{PROSPECTUS_SQL},
start0 AS (SELECT doc_id, coalesce(min(p) FILTER (contains(upper(text), 'TABLE OF CONTENTS')), min(p) FILTER (regexp_matches(text, '(?im)^\s*CONTENTS\s*$'))) AS toc_start
  FROM pages_ WHERE p < 20 GROUP BY doc_id),
tl AS (SELECT doc_id, p, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS i FROM pages_ JOIN start0 USING (doc_id) WHERE p >= toc_start AND p < toc_start + 4),
tq AS (SELECT doc_id, p, trim(raw) AS line, row_number() OVER (PARTITION BY doc_id ORDER BY p, i) AS k FROM tl),
t2 AS (SELECT *, line = '' OR contains(upper(line), 'CONTENTS') AS skip, regexp_matches(line, '^(.*?)\s*[.…]{{4,}}\s*(\d{{1,4}})\s*$') AS is_entry FROM tq),
walk(doc_id, k, p, pending, title, page, pageno_found) AS (
  WITH RECURSIVE w AS (
    SELECT doc_id, CAST(0 AS BIGINT) AS k, -1 AS p, '' AS pending, CAST(NULL AS VARCHAR) AS title, CAST(NULL AS INT) AS page, 0 AS n FROM start0 WHERE toc_start IS NOT NULL
    UNION ALL
    SELECT w.doc_id, t.k, t.p,
      CASE WHEN t.skip THEN CASE WHEN t.p <> w.p THEN '' ELSE w.pending END WHEN t.is_entry THEN '' WHEN {HEADING_SQL.format(x='t.line')} AND length(CASE WHEN t.p <> w.p THEN '' ELSE w.pending END) < 150
        THEN trim(CASE WHEN t.p <> w.p THEN '' ELSE w.pending END || ' ' || t.line) ELSE '' END,
      CASE WHEN t.is_entry AND NOT t.skip THEN trim(CASE WHEN t.p <> w.p THEN '' ELSE w.pending END || ' ' || regexp_extract(t.line, '^(.*?)\s*[.…]{{4,}}\s*(\d{{1,4}})\s*$', 1)) END,
      CASE WHEN t.is_entry AND NOT t.skip THEN CAST(regexp_extract(t.line, '(\d{{1,4}})\s*$', 1) AS INT) END, 0
    FROM w JOIN t2 t ON t.doc_id = w.doc_id AND t.k = w.k + 1)
  SELECT * FROM w),
en0 AS (SELECT doc_id, p, k, title, page FROM walk WHERE title IS NOT NULL AND {HEADING_SQL.format(x='title')}),
perpage AS (SELECT s.doc_id, g.p, count(en0.k) AS n FROM start0 s JOIN (SELECT DISTINCT doc_id, p FROM tq) g ON g.doc_id = s.doc_id LEFT JOIN en0 ON en0.doc_id = g.doc_id AND en0.p = g.p GROUP BY ALL),
stop AS (SELECT doc_id, min(p) AS stop_p FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY p) AS upto FROM perpage) WHERE n = 0 AND upto > 0 GROUP BY doc_id),
entries AS (SELECT e.doc_id, CAST(row_number() OVER (PARTITION BY e.doc_id ORDER BY k) - 1 AS INT) AS pos, regexp_replace(title, '\s+', ' ', 'g') AS title, page
  FROM en0 e LEFT JOIN stop ON stop.doc_id = e.doc_id WHERE stop_p IS NULL OR e.p < stop_p),
fl AS (SELECT doc_id, p, i, p - TRY_CAST(regexp_extract(trim(line), '^(?:[Pp]age\s*[|:]?\s*)?(\d{{1,4}})$', 1) AS INT) AS d FROM (
   SELECT doc_id, p, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM pages_)),
offs AS (SELECT doc_id, arg_max(d, n * 1000000 - seen) AS page_offset FROM (SELECT doc_id, d, count(*) AS n, min(p * 1000 + i) AS seen FROM fl WHERE d BETWEEN 0 AND 60 GROUP BY ALL) GROUP BY doc_id),
ecount AS (SELECT s.doc_id, toc_start, page_offset, count(e.pos) AS n FROM start0 s LEFT JOIN entries e ON e.doc_id = s.doc_id LEFT JOIN offs o ON o.doc_id = s.doc_id GROUP BY ALL),
okdoc AS (SELECT * FROM ecount WHERE n >= 5 AND page_offset IS NOT NULL),
npages AS (SELECT doc_id, max(p) AS last_index FROM pages_ GROUP BY doc_id),
want AS (SELECT e.doc_id, pos, e.title, e.page + page_offset AS expected, page_offset, left({TITLE_NAME.format(t='e.title')}, 30) AS wanted FROM entries e JOIN okdoc USING (doc_id)),
hit AS (SELECT w.doc_id, w.pos, arg_min(g.p, sh.prio) AS idx FROM want w, (VALUES (0, 0), (1, 1), (2, -1), (3, 2), (4, -2), (5, 3), (6, -3)) sh(prio, s)
   JOIN pages_ g ON g.doc_id = w.doc_id AND g.p = w.expected + s WHERE contains(upper(trim(regexp_replace(translate(g.text, '’‘–—', '''''--'), '\s+', ' ', 'g'))), w.wanted) GROUP BY ALL),
loc AS (SELECT w.*, coalesce(idx, expected) AS idx, idx IS NOT NULL AS verified, CASE WHEN regexp_matches(title, '^SECTION\s+[IVXL]+\s*[-–—:]?\s*', 'i') THEN 1 ELSE 2 END AS level
   FROM want w LEFT JOIN hit USING (doc_id, pos)),
nx AS (SELECT *, lead(idx) OVER w AS next_any, first_value(CASE WHEN level = 1 THEN idx END IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_part
   FROM loc WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
sections AS (SELECT nx.doc_id, pos, title, {SECTION_KEY_SQL.format(name='nm')} AS key, level, idx - page_offset AS start_page, e - page_offset AS end_page, idx AS start_index, e AS end_index, verified, nm, page_offset
  FROM (SELECT nx.*, {TITLE_NAME.format(t='title')} AS nm, CASE WHEN CASE WHEN level = 2 THEN next_any ELSE next_part END IS NULL THEN last_index ELSE greatest(idx, CASE WHEN level = 2 THEN next_any ELSE next_part END - 1) END AS e
     FROM nx JOIN npages USING (doc_id)) nx),
keyed AS (SELECT * FROM sections WHERE key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY pos) = 1),
secpage AS (SELECT k.doc_id, k.key, g.p - page_offset AS page, trim(regexp_replace(g.text, '\s+', ' ', 'g')) AS text, row_number() OVER (PARTITION BY k.doc_id, k.key ORDER BY g.p) AS nth
  FROM keyed k JOIN pages_ g ON g.doc_id = k.doc_id AND g.p BETWEEN start_index AND end_index)"""
CHUNK_TAGS_SQL = f"""{SECTIONS_SQL},
cover AS (SELECT g.doc_id, g.p, g.text, o.page_offset, arg_max(s.pos, s.level * 1000 + s.pos) AS pos FROM pages_ g JOIN okdoc o ON o.doc_id = g.doc_id
  LEFT JOIN sections s ON s.doc_id = g.doc_id AND g.p BETWEEN s.start_index AND s.end_index GROUP BY ALL),
tagged AS (SELECT c.*, s.key AS section, s.title AS section_title, s.title IS NULL OR regexp_matches(s.nm, '{V.SKIPPED_SECTIONS}') AS skipped FROM cover c LEFT JOIN sections s ON s.doc_id = c.doc_id AND s.pos = c.pos)"""


def packed_sql(source: str, size: int, overlap: int) -> str:
    return f"""pk AS (SELECT * EXCLUDE (text), list_reduce(list_concat({_atoms_sql('text', size, V.SEPARATORS)}, ['']), lambda s, a:
   CASE WHEN a = '' THEN {{'cur': []::VARCHAR[], 'out': CASE WHEN len(s.cur) > 0 THEN list_append(s.out, array_to_string(s.cur, '')) ELSE s.out END}}
        WHEN len(s.cur) > 0 AND length(array_to_string(s.cur, '')) + length(a) > {size}
        THEN {{'cur': list_append(s.cur[len(s.cur) - coalesce(list_max(list_filter(generate_series(1, len(s.cur)), lambda n:
               length(array_to_string(s.cur[len(s.cur) - n + 1 :], '')) <= least({overlap}, {size} - length(a)))), 0) + 1 :], a),
              'out': list_append(s.out, array_to_string(s.cur, ''))}}
        ELSE {{'cur': list_append(s.cur, a), 'out': s.out}} END, {{'cur': []::VARCHAR[], 'out': []::VARCHAR[]}}).out AS out FROM {source})"""


RISK_LINES_SQL = f"""rlines AS (SELECT doc_id, j, 24 + j // 10 AS page, {LINE_TEXT.replace(' DIV ', ' // ')} AS text, {LINE_BOLD} AS bold
  FROM (SELECT s_suppkey AS doc_id, CAST(unnest(generate_series(0, 63)) AS INT) AS j FROM supplier)),
rl AS (SELECT *, TRY_CAST(regexp_extract(text, '^(\\d{{1,3}})[.)]', 1) AS INT) AS num, bold AND (regexp_matches(text, '^\\d{{1,3}}[.)](\\s|[“"‘'']?[A-Z]|$)')) AS heading_like FROM rlines),
risks AS (WITH RECURSIVE w AS (
   SELECT DISTINCT doc_id, -1 AS j, 0 AS last, FALSE AS open_, CAST(NULL AS VARCHAR) AS grp, FALSE AS started, FALSE AS more FROM rlines
   UNION ALL SELECT w.doc_id, r.j, CASE WHEN heading_like AND num > last AND num <= last + 3 THEN num ELSE last END,
     (heading_like AND num > last AND num <= last + 3) OR (open_ AND bold),
     CASE WHEN NOT (heading_like AND num > last AND num <= last + 3) AND NOT (open_ AND bold) AND bold AND contains(upper(text), 'RISK') AND length(text) < 100 AND regexp_matches(text, '^\\p{{Lu}}')
        AND NOT regexp_matches(text, '\\.\\s*$') AND NOT starts_with(upper(text), 'SECTION') THEN trim(rtrim(text, ':')) ELSE grp END,
     (heading_like AND num > last AND num <= last + 3), NOT (heading_like AND num > last AND num <= last + 3) AND open_ AND bold
   FROM w JOIN rl r ON r.doc_id = w.doc_id AND r.j = w.j + 1)
  SELECT w.doc_id, w.last AS number, trim(string_agg(CASE WHEN started THEN regexp_replace(r.text, '^\\d{{1,3}}[.)]\\s*', '') ELSE r.text END, ' ' ORDER BY w.j)) AS text,
    min(r.page) FILTER (started) AS page, arg_min(grp, w.j) AS grp FROM w JOIN rl r ON r.doc_id = w.doc_id AND r.j = w.j WHERE started OR more GROUP BY w.doc_id, w.last)"""


@shared
def risk_lines(spark, sf):
    text, bold = LINE_TEXT, LINE_BOLD
    return table(spark, sf, "supplier").selectExpr("s_suppkey AS doc_id").selectExpr(
        "doc_id", f"transform(sequence(0, 63), j -> named_struct('page', CAST(24 + j DIV 10 AS INT), 'text', {text}, 'bold', {bold})) AS lines")


def register(r: Registry) -> None:
    r.add("find_toc_start", lambda spark, sf: prospectuses(spark, sf).select("doc_id", S.find_toc_start(F.col("pages")).alias("toc_start")),
          f"WITH {SECTIONS_SQL} SELECT doc_id, toc_start FROM start0")
    r.add("read_toc", lambda spark, sf: parsed(spark, sf).select("doc_id", F.posexplode("entries").alias("pos", "e")).select(
        "doc_id", "pos", "e.title", "e.page"), f"WITH {SECTIONS_SQL} SELECT doc_id, pos, title, page FROM entries")
    r.add("page_offset", lambda spark, sf: parsed(spark, sf).select("doc_id", "page_offset"),
          f"WITH {SECTIONS_SQL} SELECT n.doc_id, page_offset FROM npages n LEFT JOIN offs o ON o.doc_id = n.doc_id")
    shown = ["doc_id", "pos", "title", "key", "level", "start_page", "end_page", "start_index", "end_index", "verified"]
    r.add("locate_start", lambda spark, sf: S.section_rows(parsed(spark, sf)).select("doc_id", "pos", "start_index", "verified"),
          f"WITH {SECTIONS_SQL} SELECT doc_id, pos, start_index, verified FROM sections")
    r.add("section_ranges", lambda spark, sf: S.section_rows(parsed(spark, sf)).select(*shown), f"WITH {SECTIONS_SQL} SELECT {', '.join(shown)} FROM sections")
    r.add("sections_by_key", lambda spark, sf: parsed(spark, sf).select("doc_id", F.inline(S.keyed_sections(F.col("sections")))).select("doc_id", "key", "pos"),
          f"WITH {SECTIONS_SQL} SELECT doc_id, key, pos FROM keyed")
    r.add("missing_sections", lambda spark, sf: parsed(spark, sf).select(
        "doc_id", "reject_reason", F.array_join(S.missing_sections(F.col("sections")), ",").alias("missing")).where("reject_reason IS NOT NULL OR missing <> ''"), f"""
        WITH {SECTIONS_SQL}, req(o, key) AS (VALUES {', '.join(f"({i}, '{k}')" for i, k in enumerate(V.REQUIRED_SECTIONS))}),
        lack AS (SELECT d.doc_id, string_agg(req.key, ',' ORDER BY o) AS missing FROM okdoc d, req WHERE (d.doc_id, req.key) NOT IN (SELECT doc_id, key FROM keyed) GROUP BY d.doc_id)
        SELECT e.doc_id, CASE WHEN toc_start IS NULL THEN 'no table of contents' WHEN n < 5 THEN 'contents could not be read' WHEN page_offset IS NULL THEN 'no printed page numbers' END AS reject_reason, missing
        FROM ecount e LEFT JOIN lack ON lack.doc_id = e.doc_id WHERE missing IS NOT NULL OR toc_start IS NULL OR n < 5 OR page_offset IS NULL""")
    for name, key, first in (("section_pages", "litigation", None), ("section_opening_pages", "business", 2)):
        r.add(name, lambda spark, sf, key=key, first=first: S.section_pages(parsed(spark, sf), key, first).select(
            "doc_id", F.inline("section_pages")), f"WITH {SECTIONS_SQL} SELECT doc_id, page, text FROM secpage WHERE key = '{key}'" + (f" AND nth <= {first}" if first else ""))
    r.add("scan_first", lambda spark, sf: S.section_pages(parsed(spark, sf), "capital_structure").select(
        "doc_id", F.inline(F.array_compact(F.array(S.scan_first(F.col("section_pages"), V.NONE_PLEDGED))))).select("doc_id", "page", "text"), rf"""
        WITH {SECTIONS_SQL}, m AS (SELECT doc_id, page, regexp_extract(text, '(?i)(none of the equity shares held by (?:our |the )?promoters?\b[^.]{{0,120}}?\b(?:is|are) pledged)', 1) AS text FROM secpage WHERE key = 'capital_structure')
        SELECT doc_id, page, text FROM m WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page) = 1""")

    def pledges(spark, sf):
        said = S.section_pages(parsed(spark, sf), "capital_structure").select("doc_id", S.scan_first(F.col("section_pages"), V.NONE_PLEDGED).alias("h"))
        return derived(spark, sf, "promoters").join(said, "doc_id", "left").select(
            "doc_id", F.when(F.col("h").isNotNull(), False).otherwise(F.col("shares_pledged")).alias("shares_pledged"),
            F.coalesce(F.col("h.text"), F.lit("model's reading of the excerpts")).alias("source"), F.col("h.page").alias("page"))

    r.add("pledge_status", pledges, rf"""
        WITH {SECTIONS_SQL}, {check_sql('promoters')}, m AS (SELECT doc_id, page, regexp_extract(text, '(?i)(none of the equity shares held by (?:our |the )?promoters?\b[^.]{{0,120}}?\b(?:is|are) pledged)', 1) AS text FROM secpage WHERE key = 'capital_structure'),
        h AS (SELECT doc_id, page, text FROM m WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page) = 1)
        SELECT promoters.doc_id, CASE WHEN h.text IS NOT NULL THEN FALSE ELSE shares_pledged END AS shares_pledged, coalesce(h.text, 'model''s reading of the excerpts') AS source, h.page
        FROM promoters LEFT JOIN h ON h.doc_id = promoters.doc_id""")
    r.add("tag_chunks", lambda spark, sf: S.tagged_chunks(parsed(spark, sf)), f"""
        WITH {CHUNK_TAGS_SQL}, useful AS (SELECT doc_id, p, page_offset, section, section_title, text FROM tagged WHERE NOT skipped), {packed_sql('useful', 800, 100)},
        fl2 AS (SELECT doc_id, p, page_offset, section, section_title, unnest(out) AS piece, unnest(range(len(out))) AS i FROM pk)
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p, i) - 1 AS INT) AS chunk_id, p - page_offset AS page, section, section_title, regexp_replace(piece, '^\\s+|\\s+$', '', 'g') AS text FROM fl2""")
    r.add("index_statistics", lambda spark, sf: S.index_statistics(parsed(spark, sf)), f"""
        WITH {CHUNK_TAGS_SQL}, useful AS (SELECT doc_id, p, text FROM tagged WHERE NOT skipped), {packed_sql('useful', 800, 100)},
        n AS (SELECT doc_id, CAST(sum(len(out)) AS BIGINT) AS chunks FROM pk GROUP BY doc_id)
        SELECT t.doc_id, any_value(coalesce(chunks, 0)) AS chunks, count(*) FILTER (skipped) AS skipped_pages FROM tagged t LEFT JOIN n ON n.doc_id = t.doc_id GROUP BY t.doc_id""")

    # risk headings
    r.add("risk_headings", lambda spark, sf: risk_lines(spark, sf).select("doc_id", F.inline(S.risk_headings(F.col("lines")))),
          f"WITH {RISK_LINES_SQL} SELECT doc_id, number, text, page, grp FROM risks")
    r.add("is_group_title", lambda spark, sf: risk_lines(spark, sf).select("doc_id", F.posexplode("lines").alias("j", "l")).select(
        "doc_id", "j", S.is_group_title(F.col("l.text")).alias("group_title")), f"""
        WITH {RISK_LINES_SQL} SELECT doc_id, j, contains(upper(text), 'RISK') AND length(text) < 100 AND regexp_matches(text, '^\\p{{Lu}}')
          AND NOT regexp_matches(text, '\\.\\s*$') AND NOT starts_with(upper(text), 'SECTION') AS group_title FROM rlines""")
    r.add("line_is_bold", lambda spark, sf: S.line_is_bold(derived(spark, sf, "spans")), f"""
        WITH {check_sql('spans')} SELECT doc_id, line_no, sum(CASE WHEN bold THEN length(trim(text)) ELSE 0 END) / sum(length(trim(text))) >= 0.8 AS bold
        FROM spans GROUP BY ALL HAVING sum(length(trim(text))) > 0""")

    # evidence
    r.add("collect_evidence", lambda spark, sf: E.collect_evidence(derived(spark, sf, "excerpts")), f"""
        WITH {check_sql('excerpts')}, pg AS (SELECT * FROM excerpts WHERE kind = 'page' QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY prio) = 1),
        h AS (SELECT x.* FROM excerpts x LEFT JOIN pg ON pg.doc_id = x.doc_id AND pg.page = x.page AND pg.prio < x.prio WHERE x.kind = 'hit' AND pg.page IS NULL
          QUALIFY row_number() OVER (PARTITION BY x.doc_id, x.chunk_id ORDER BY x.prio) = 1)
        SELECT doc_id, prio, kind, page, chunk_id, text FROM pg UNION ALL SELECT doc_id, prio, kind, page, chunk_id, text FROM h""")

    def page_structs(spark, sf):
        return document_pages(spark, sf).select("doc_id", F.transform("pages", lambda t, i: F.struct((i + 1).alias("page"), t.alias("text"))).alias("pages"))

    cost = "((length({x}) - length(regexp_replace({x}, '[^0-9]', '', 'g'))) // 4 + length(regexp_replace({x}, '[^0-9]', '', 'g')) + 1)"
    r.add("pack_budget", lambda spark, sf: page_structs(spark, sf).select(
        "doc_id", F.inline(E.pack_budget(F.reverse("pages"), 600))).select("doc_id", "page"), f"""
        WITH RECURSIVE {PAGES_SQL}, o AS (SELECT doc_id, page, {cost.format(x='text')} + 6 AS cost, row_number() OVER (PARTITION BY doc_id ORDER BY page DESC) AS k FROM doc_pages),
        w AS (SELECT doc_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS used, FALSE AS kept, CAST(0 AS BIGINT) AS page FROM o WHERE k = 1
          UNION ALL SELECT o.doc_id, o.k, CASE WHEN used + cost <= 600 THEN used + cost ELSE used END, used + cost <= 600, o.page FROM w JOIN o ON o.doc_id = w.doc_id AND o.k = w.k + 1)
        SELECT doc_id, CAST(page AS INT) AS page FROM w WHERE kept""")
    r.add("page_batches", lambda spark, sf: page_structs(spark, sf).select("doc_id", F.inline(E.page_batches(F.col("pages")))), f"""
        WITH RECURSIVE {PAGES_SQL}, o AS (SELECT doc_id, page, {cost.format(x='text')} AS cost FROM doc_pages),
        w AS (SELECT doc_id, page, cost AS used, 0 AS batch FROM o WHERE page = 1
          UNION ALL SELECT o.doc_id, o.page, CASE WHEN used + cost > 3600 THEN cost ELSE used + cost END, CASE WHEN used + cost > 3600 THEN batch + 1 ELSE batch END
          FROM w JOIN o ON o.doc_id = w.doc_id AND o.page = w.page + 1)
        SELECT doc_id, CAST(page AS INT) AS page, batch FROM w""")
    r.add("select_pages", lambda spark, sf: S.section_pages(parsed(spark, sf), "approvals").select(
        "doc_id", F.inline(E.select_pages(F.col("section_pages")))).select("doc_id", "page"), f"""
        WITH {SECTIONS_SQL} SELECT doc_id, page FROM secpage WHERE key = 'approvals' AND (nth = 1 OR regexp_matches(text, 'applied for|not yet (?:been )?received|yet to (?:be )?(?:apply|obtain)|expired', 'i'))""")
    r.add("validate_answers", lambda spark, sf: E.validate_answers(derived(spark, sf, "answer_replies")), f"""
        WITH {check_sql('answer_replies')}, j AS (SELECT doc_id, TRY_CAST(json AS JSON) AS j FROM answer_replies),
        f AS (SELECT doc_id, j, CAST(j->>'$.number' AS INT) AS number, j->>'$.headline' AS headline, j->>'$.category' AS category, CAST(j->>'$.score' AS INT) AS score, j->>'$.note' AS note FROM j)
        SELECT doc_id, number, headline, category, score, coalesce(note, '') AS note, CASE WHEN j IS NULL THEN 'not valid JSON' WHEN number IS NULL OR headline IS NULL OR category IS NULL OR score IS NULL THEN 'missing field'
          WHEN category NOT IN ({', '.join(f"'{c}'" for c in V.RISK_CATEGORIES)}) THEN 'unknown category' WHEN score NOT BETWEEN 1 AND 5 THEN 'score out of range' END AS reject_reason FROM f""")
