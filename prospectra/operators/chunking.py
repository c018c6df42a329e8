"""Structure-aware and fixed-window chunking, inside each document's own row (no shuffle)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospectra.functions import fixed_values as V
from prospectra.functions.columns import strip

LINES_PER_PAGE = 4


def pages_of_lines(text: Column, lines_per_page: int = LINES_PER_PAGE) -> Column:
    """Plain text cut into pages of a fixed number of lines (array of page texts)."""
    lines = F.split(text, "\n")
    last = F.floor((F.size(lines) - 1) / lines_per_page).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(
        F.slice(lines, i * lines_per_page + 1, F.lit(lines_per_page)), "\n"))


def _atoms(text: Column, size: int, separators: tuple[str, ...]) -> Column:
    """Pieces shorter than `size`, each keeping its leading separator.

    Pieces that had to be cut by a finer separator are fenced by empty strings, because
    they are packed apart from their neighbours.
    """
    separator, finer = separators[0], separators[1:]
    if separator == "":
        return F.filter(F.split(text, ""), lambda c: c != "")
    parts = F.split(text, re.escape(separator).replace("\\\n", "\n"), -1)
    pieces = F.filter(
        F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit(separator), p))),
        lambda p: p != "")
    fence = F.array(F.lit(""))
    # a text without this separator is one long piece and goes on to the finer ones
    return F.flatten(F.transform(pieces, lambda p: F.when(F.length(p) < size, F.array(p)).otherwise(
        F.concat(fence, _atoms(p, size, finer), fence))))


def _pack(atoms: Column, size: int, overlap: int) -> Column:
    """Greedy packing; each next chunk starts with the longest tail that fits the overlap."""
    empty = F.array().cast("array<string>")

    def state(current: Column, total: Column, done: Column) -> Column:
        return F.struct(current.alias("current"), total.cast("int").alias("total"), done.alias("done"))

    def closed(s: Column) -> Column:
        return F.concat(s["done"], F.array(strip(F.array_join(s["current"], ""))))

    def tail(s: Column, atom: Column) -> Column:
        room = F.least(F.lit(overlap), F.lit(size) - F.length(atom))
        fit = F.aggregate(
            F.reverse(s["current"]),
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("t"), F.lit(True).alias("more")),
            lambda a, x: F.when(a["more"] & (a["t"] + F.length(x) <= room), F.struct(
                (a["n"] + 1).alias("n"), (a["t"] + F.length(x)).alias("t"), F.lit(True).alias("more"))).otherwise(
                F.struct(a["n"].alias("n"), a["t"].alias("t"), F.lit(False).alias("more"))))
        return fit

    def step(s: Column, atom: Column) -> Column:
        # a one-element transform binds the tail once for both fields that need it
        overflow = F.element_at(F.transform(F.array(tail(s, atom)), lambda t: state(
            F.concat(F.slice(s["current"], F.size(s["current"]) - t["n"] + 1, t["n"]), F.array(atom)),
            t["t"] + F.length(atom), closed(s))), 1)
        return (F.when(atom == "", state(empty, F.lit(0), F.when(F.size(s["current"]) > 0, closed(s)).otherwise(s["done"])))
                .when((F.size(s["current"]) > 0) & (s["total"] + F.length(atom) > size), overflow)
                .otherwise(state(F.concat(s["current"], F.array(atom)), s["total"] + F.length(atom), s["done"])))

    packed = F.aggregate(F.concat(atoms, F.array(F.lit(""))), state(empty, F.lit(0), empty), step, lambda s: s["done"])
    return F.filter(packed, lambda c: c != "")


def split_text(text: Column, size: int, overlap: int, separators: tuple[str, ...] = V.SEPARATORS) -> Column:
    """Chunks of one page text."""
    whole = F.filter(F.array(strip(text)), lambda c: c != "")
    return F.when(F.length(text) <= size, whole).otherwise(_pack(_atoms(text, size, separators), size, overlap))


def chunk_pages(documents: DataFrame, size: int = V.GENERAL_CHUNKS[0], overlap: int = V.GENERAL_CHUNKS[1],
                pages: str = "pages") -> DataFrame:
    """One row per chunk of every page; chunk ids run over the document, chunks never span pages."""
    pieces = F.flatten(F.transform(F.col(pages), lambda text, i: F.transform(
        split_text(text, size, overlap), lambda c: F.struct((i + 1).alias("page"), c.alias("text")))))
    keep = [c for c in documents.columns if c != pages]
    return (documents.select(*keep, F.posexplode(pieces).alias("chunk_id", "__c"))
            .select(*keep, "chunk_id", "__c.page", "__c.text"))


def fixed_windows(text: Column, size: int, overlap: int) -> Column:
    """Sliding character windows, trimmed, blank ones dropped."""
    step = size - overlap
    count = F.when(F.length(text) <= size, 1).otherwise(F.ceil((F.length(text) - overlap) / step)).cast("int")
    windows = F.transform(F.sequence(F.lit(0), count - 1), lambda i: strip(F.substring(text, i * step + 1, F.lit(size))))
    return F.filter(windows, lambda w: w != "")


def chunk_fixed(documents: DataFrame, size: int, overlap: int) -> DataFrame:
    keep = [c for c in documents.columns if c != "text"]
    return documents.select(*keep, F.posexplode(fixed_windows(F.col("text"), size, overlap)).alias("chunk_id", "text"))


def page_sections(page_count: Column, sections: Column) -> Column:
    """Most specific section of each page: level 2 over level 1, the later entry of a level wins.

    `sections` is an array of structs with level, start_index, end_index; the result holds
    one element per page index, null before the first section.
    """
    ranked = F.transform(sections, lambda s, i: F.struct(s["level"].alias("level"), i.alias("i"), s.alias("s")))
    return F.transform(F.sequence(F.lit(0), page_count - 1), lambda p: F.array_max(F.transform(
        F.filter(ranked, lambda r: (r["s"]["start_index"] <= p) & (p <= r["s"]["end_index"])),
        lambda r: F.struct(r["level"].alias("level"), r["i"].alias("i"))))["i"])
