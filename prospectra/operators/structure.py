"""Document structure: contents, page numbering, sections, risk headings.

A document is one row whose `pages` column holds its page texts in order, so reading its
contents page, locating sections and folding over its lines is all done inside the row:
parsing a corpus is a map-only job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospectra.functions import fixed_values as V
from prospectra.functions.columns import bind, computed, first_match, lit_array, strip
from prospectra.functions.text import (
    collapse_ws, is_skipped_section, looks_like_heading, normalise_title, section_key, without_section_prefix,
)
from prospectra.operators.chunking import page_sections, split_text
from prospectra.operators.ordered import id_bucket, last_before

ENTRIES = "array<struct<title:string,page:int>>"
LINE_BREAK = r"\R"


def find_toc_start(pages: Column) -> Column:
    """Index of the contents page within the first pages, null when there is none."""
    head = F.slice(pages, 1, V.TOC_SEARCH_PAGES)
    titled = F.array_position(F.transform(head, lambda t: F.contains(F.upper(t), F.lit("TABLE OF CONTENTS"))), F.lit(True))
    bare = F.array_position(F.transform(head, lambda t: t.rlike(r"(?im)^\s*CONTENTS\s*$")), F.lit(True))
    return F.when(titled > 0, titled - 1).when(bare > 0, bare - 1).cast("int")


def read_toc(pages: Column, start: Column) -> Column:
    """Entries (title, printed page) from the contents pages; a wrapped title joins the line with its number."""
    def line_state(entries: Column, pending: Column, found: Column) -> Column:
        return F.struct(entries.alias("entries"), pending.alias("pending"), found.alias("found"))

    def read_line(s: Column, raw: Column) -> Column:
        return bind(strip(raw), lambda line: bind(
            F.trim(F.concat(s["pending"], F.lit(" "), F.regexp_extract(line, V.TOC_ENTRY, 1))), lambda title: next_state(s, line, title)))

    def next_state(s: Column, line: Column, title: Column) -> Column:
        page = F.regexp_extract(line, V.TOC_ENTRY, 2).cast("int")
        entry = F.array(F.struct(collapse_ws(title).alias("title"), page.alias("page")))
        return first_match([
            ((line == "") | F.contains(F.upper(line), F.lit("CONTENTS")), s),
            (line.rlike(V.TOC_ENTRY), F.when(looks_like_heading(title), line_state(F.concat(s["entries"], entry), F.lit(""), s["found"] + 1))
             .otherwise(line_state(s["entries"], F.lit(""), s["found"]))),
            (looks_like_heading(line) & (F.length(s["pending"]) < V.TOC_MAX_PENDING),
             line_state(s["entries"], F.trim(F.concat_ws(" ", s["pending"], line)), s["found"]))],
            line_state(s["entries"], F.lit(""), s["found"]))

    def read_page(s: Column, text: Column) -> Column:
        read = F.aggregate(F.split(text, LINE_BREAK), line_state(s["entries"], F.lit(""), F.lit(0)), read_line,
                           lambda r: F.struct(r["entries"].alias("entries"), ((F.size(r["entries"]) > 0) & (r["found"] == 0)).alias("ended")))
        return F.when(s["ended"], s).otherwise(read)

    empty = F.struct(F.array().cast(ENTRIES).alias("entries"), F.lit(False).alias("ended"))
    return F.aggregate(F.slice(pages, start + 1, F.lit(V.TOC_MAX_PAGES)), empty, read_page, lambda s: s["entries"])


def footer_differences(pages: Column) -> Column:
    """index - printed number for every line that is only a page number and could be this page's."""
    return F.flatten(F.transform(pages, lambda text, i: F.filter(F.transform(
        F.split(text, LINE_BREAK), lambda line: i - F.regexp_extract(strip(line), V.PAGE_NUMBER_LINE, 1).try_cast("int")),
        lambda d: d.between(0, V.MAX_COVER_PAGES))))


def most_common(values: Column) -> Column:
    """The most frequent element; ties go to the one seen first."""
    ranked = F.transform(F.array_distinct(values), lambda d: F.struct(
        F.size(F.filter(values, lambda x: x == d)).alias("n"), F.negative(F.array_position(values, d)).alias("seen"), d.alias("d")))
    return F.array_max(ranked)["d"]


def locate(title: Column, expected: Column, normalised: Column) -> Column:
    """(index, verified): where the title really appears, trying the nearest pages; else the expected page."""
    hits = bind(F.substring(without_section_prefix(title), 1, V.TITLE_PROBE_CHARS), lambda wanted: F.filter(
        F.transform(lit_array(V.TITLE_SHIFTS), lambda s: expected + s),
        lambda i: (i >= 0) & F.coalesce(F.contains(F.get(normalised, i), wanted), F.lit(False))))
    return bind(F.get(hits, F.lit(0)), lambda hit: F.struct(F.coalesce(hit, expected).alias("index"), hit.isNotNull().alias("verified")))


def section_ranges(located: Column, offset: Column, last_index: Column) -> Column:
    """Sections with level, key and page ranges. Chapters end before the next entry, parts before the next part."""
    def close(e: Column, i: Column) -> Column:
        later = F.filter(F.slice(located, i + 2, F.size(located)), lambda x: (e["level"] == 2) | (x["level"] == 1))
        return bind(F.get(later, F.lit(0)), lambda following: describe(e, i, F.when(
            following.isNotNull(), F.greatest(e["at"]["index"], following["at"]["index"] - 1)).otherwise(last_index)))

    def describe(e: Column, i: Column, end: Column) -> Column:
        return F.struct(i.alias("pos"), e["title"].alias("title"), section_key(e["title"]).alias("key"), e["level"].alias("level"),
                        (e["at"]["index"] - offset).alias("start_page"), (end - offset).alias("end_page"),
                        e["at"]["index"].alias("start_index"), end.alias("end_index"), e["at"]["verified"].alias("verified"))

    return F.transform(located, close)


def parse_sections(documents: DataFrame) -> DataFrame:
    """Adds toc_start, entries, page_offset, sections and reject_reason to documents with a `pages` array."""
    c = F.col
    d = computed(documents, toc_start=find_toc_start(c("pages")), page_offset=bind(footer_differences(c("pages")), most_common))
    d = computed(d, entries=F.when(c("toc_start").isNotNull(), read_toc(c("pages"), c("toc_start"))))
    readable = (F.size("entries") >= V.TOC_MIN_ENTRIES) & c("page_offset").isNotNull()
    located = bind(F.transform("pages", normalise_title), lambda pages: F.transform("entries", lambda e: F.struct(
        e["title"].alias("title"), F.when(e["title"].rlike(V.SECTION_PREFIX), 1).otherwise(2).alias("level"),
        locate(e["title"], e["page"] + c("page_offset"), pages).alias("at"))))
    sections = bind(located, lambda l: section_ranges(l, c("page_offset"), F.size("pages") - 1))
    return computed(d, sections=F.when(readable, sections), reject_reason=first_match([
        (c("toc_start").isNull(), "no table of contents"), (F.size("entries") < V.TOC_MIN_ENTRIES, "contents could not be read"),
        (c("page_offset").isNull(), "no printed page numbers")]))


def section_rows(parsed: DataFrame) -> DataFrame:
    return parsed.select("doc_id", F.inline("sections"))


def keyed_sections(sections: Column) -> Column:
    """The first section of every key."""
    keys = F.transform(sections, lambda s: s["key"])
    return F.filter(sections, lambda s, i: s["key"].isNotNull() & (F.array_position(keys, s["key"]) == i + 1))


def section_of(sections: Column, key: str) -> Column:
    return F.get(F.filter(sections, lambda s: s["key"] == key), F.lit(0))


def missing_sections(sections: Column) -> Column:
    """Required keys the document lacks, in their fixed order."""
    return F.array_except(lit_array(V.REQUIRED_SECTIONS), F.array_compact(F.transform(sections, lambda s: s["key"])))


def section_pages(parsed: DataFrame, key: str, first: int | None = None) -> DataFrame:
    """Adds `section_pages`: (printed page, clean text) of the pages of a section, all or the first few; empty without it."""
    d = computed(parsed, __s=section_of(F.col("sections"), key))
    end = F.col("__s.end_index") if first is None else F.least(F.col("__s.end_index"), F.col("__s.start_index") + first - 1)
    pages = F.transform(F.sequence(F.col("__s.start_index"), end), lambda i: F.struct(
        (i - F.col("page_offset")).alias("page"), collapse_ws(F.get("pages", i)).alias("text")))
    none = F.array().cast("array<struct<page:int,text:string>>")
    return computed(d, section_pages=F.coalesce(pages, none)).drop("__s")


def scan_first(pages: Column, pattern: str) -> Column:
    """(page, text) of the first page in which a standard sentence appears, null if none does."""
    hits = F.filter(F.transform(pages, lambda p: F.struct(p["page"].alias("page"), F.regexp_extract(p["text"], f"({pattern})", 1).alias("text"))),
                    lambda h: h["text"] != "")
    return F.get(hits, F.lit(0))


def tagged_chunks(parsed: DataFrame, size: int = V.OFFER_CHUNKS[0], overlap: int = V.OFFER_CHUNKS[1]) -> DataFrame:
    """Chunks of the useful pages with their section: (doc_id, chunk_id, page, section, section_title, text)."""
    d = computed(parsed, __at=page_sections(F.size("pages"), F.col("sections")))
    d = computed(d, __pages=F.filter(F.transform("pages", lambda t, i: F.struct(
        i.alias("i"), F.get("sections", F.get("__at", i)).alias("s"), t.alias("text"))), lambda p: ~is_skipped_section(p["s"]["title"])))
    pieces = F.flatten(F.transform("__pages", lambda p: F.transform(split_text(p["text"], size, overlap), lambda c: F.struct(
        (p["i"] - F.col("page_offset")).alias("page"), p["s"]["key"].alias("section"), p["s"]["title"].alias("section_title"), c.alias("text")))))
    return d.select("doc_id", F.posexplode(pieces).alias("chunk_id", "c")).select("doc_id", "chunk_id", "c.*")


def index_statistics(parsed: DataFrame) -> DataFrame:
    """(doc_id, chunks, skipped_pages) of the search index a document gets."""
    at = page_sections(F.size("pages"), F.col("sections"))
    d = computed(parsed.where("sections IS NOT NULL"), __at=at)
    used = F.filter("__at", lambda i: ~is_skipped_section(F.get("sections", i)["title"]))
    pages = d.select("doc_id", (F.size("pages") - F.size(used)).cast("long").alias("skipped_pages"))
    chunks = tagged_chunks(parsed).groupBy("doc_id").agg(F.count("*").alias("chunks"))
    return pages.join(chunks, "doc_id", "left").select("doc_id", F.coalesce("chunks", F.lit(0).cast("long")).alias("chunks"), "skipped_pages")


# ------------------------------------------------------------------ risk headings
def line_is_bold(spans: DataFrame) -> DataFrame:
    """(doc_id, line_no, bold): at least 80 % of the characters are in bold spans; blank lines drop out."""
    n = F.length(strip(F.col("text")))
    return (spans.groupBy("doc_id", "line_no").agg(F.sum(n).alias("all"), F.sum(F.when(F.col("bold"), n).otherwise(0)).alias("b"))
            .where("all > 0").select("doc_id", "line_no", (F.col("b") / F.col("all") >= V.BOLD_SHARE).alias("bold")))


def is_group_title(text: Column) -> Column:
    upper = F.upper(text)
    return (F.contains(upper, F.lit("RISK")) & (F.length(text) < 100) & text.rlike(r"^\p{Lu}") & ~text.rlike(r"\.\s*$")
            & ~upper.startswith("SECTION"))


def risk_headings(lines: Column) -> Column:
    """Numbered bold headings (number, text, page, group) from the ordered lines (page, text, bold) of one section."""
    kind = "array<struct<number:int,text:string,page:int,grp:string>>"

    def state(risks: Column, open_: Column, group: Column, last: Column) -> Column:
        return F.struct(risks.alias("risks"), open_.alias("open"), group.alias("grp"), last.alias("last"))

    def step(s: Column, line: Column) -> Column:
        text = line["text"]
        number = F.regexp_extract(text, V.RISK_HEADING, 1).try_cast("int")
        starts = line["bold"] & text.rlike(V.RISK_HEADING) & (number > s["last"]) & (number <= s["last"] + V.RISK_NUMBER_GAP)
        heading = F.struct(number.alias("number"), F.regexp_extract(text, V.RISK_HEADING, 2).alias("text"), line["page"].alias("page"), s["grp"].alias("grp"))
        current = F.try_element_at(s["risks"], F.lit(-1))
        longer = F.struct(current["number"].alias("number"), F.trim(F.concat_ws(" ", current["text"], text)).alias("text"),
                          current["page"].alias("page"), current["grp"].alias("grp"))
        return first_match([
            (starts, state(F.concat(s["risks"], F.array(heading)), F.lit(True), s["grp"], number)),
            (s["open"] & line["bold"], state(F.concat(F.slice(s["risks"], F.lit(1), F.size(s["risks"]) - 1), F.array(longer)),
                                             F.lit(True), s["grp"], s["last"])),
            (line["bold"] & is_group_title(text), state(s["risks"], F.lit(False), strip(F.regexp_replace(text, ":+$", "")), s["last"]))],
            state(s["risks"], F.lit(False), s["grp"], s["last"]))

    start = state(F.array().cast(kind), F.lit(False), F.lit(None).cast("string"), F.lit(0))
    return F.aggregate(lines, start, step, lambda s: s["risks"])


GAP_ROWS = 65_536       # numbers of a gap that one row is expanded to


def missing_numbers(found: DataFrame) -> DataFrame:
    """(doc_id, number): gaps in 1..max. Each number looks back to the one before it, and only what lies between is listed, a wide gap in
    several rows; numbers below 1 do not count."""
    number = F.col("number").cast("long")
    held = found.select("doc_id", number.alias("number")).where("number >= 1").distinct()
    seen = last_before(held, ["doc_id"], id_bucket(F.col("number")), F.col("number"), F.col("number"), "before")
    gaps = seen.select("doc_id", (F.coalesce("before", F.lit(0).cast("long")) + 1).alias("first"), (F.col("number") - 1).alias("last")).where("first <= last")
    parts = gaps.select("doc_id", "last", F.explode(F.sequence("first", "last", F.lit(GAP_ROWS).cast("long"))).alias("first"))
    return parts.select("doc_id", F.explode(F.sequence("first", F.least("last", F.col("first") + GAP_ROWS - 1))).alias("number"))
