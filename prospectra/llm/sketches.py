"""Document fingerprints: invertible Bloom lookup tables of paragraph digests, subtracted between two versions and peeled.

A table has three parts of equally many cells. A digest falls into one cell of each part; a cell holds how many fell into it and the
exclusive or of them and of their check hashes. Tables of two versions subtract cell by cell: what both hold cancels, and peeling (a cell
with a single digest gives it away, which is then taken from its other cells) returns what only one holds. What a peeling leaves is
retried with new hashes in a table twice as large.

Everything is DataFrame functions. Cells are rows, summed by grouped aggregates; a text of any length is many rows, never one large
value. The rows of a document stay in the task that joined it with the next one, so that peeling shuffles nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prospectra.llm.common import read, written
from prospectra.operators.ordered import last_before

#: A line, cut after the words that end a sentence or clause, and after 16 words at most.
PARAGRAPH = r"(?:\S*[^\s.!?;:][^\S\n]+){0,15}\S+"
PARTS = 3
CELLS = 4               # cells of a part in the fingerprint: a power of two
LEAST = 8               # cells of a part in the smallest table that is peeled
SPARE = 0.75            # cells of a part for each paragraph of both versions, before rounding up to a power of two
ROUNDS = 9              # of peeling, each over the cells of one part, so that no digest is found twice in a round
ID_ROWS = 65_536        # ids that are put in order in one task
TASK_CHARS = 8_000_000  # code points of text in a task; its cells take some ten times their bytes

CELL, FOUND, DOCUMENT = 0, -1, -2       # places of rows: a cell (0 and above), a found digest, what is carried along


def digests(text: Column) -> Column:
    """The different paragraphs' 64-bit hashes; null and blank texts have none."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p)))


def check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit("check"))


def cell(digest: Column, part: int, cells: Column, attempt: int) -> Column:
    """The digest's cell of a part: 20 bits of one hash for each part."""
    bits = F.shiftrightunsigned(F.xxhash64(digest, F.lit(attempt)), 20 * part)
    return bits.bitwiseAND((cells - 1).cast("long")).cast("int") + cells * part


def fingerprint(text: Column, digest_array: Column) -> Column:
    """A hash of the whole text, which tells texts of equal paragraphs apart, and its table of PARTS * CELLS cells: per cell the count and
    the digests' exclusive or."""
    placed = F.transform(digest_array, lambda d: F.struct(d.alias("d"), F.array(*(cell(d, part, F.lit(CELLS), 0) for part in range(PARTS))).alias("at")))

    def shown(i: Column) -> Column:
        own = F.transform(F.filter(F.get(F.array(placed), F.lit(0)), lambda e: F.array_contains(e["at"], i)), lambda e: e["d"])
        return F.concat(F.size(own).cast("string"), F.lit(":"), F.hex(F.aggregate(own, F.lit(0).cast("long"), lambda a, d: a.bitwiseXOR(d))))

    return F.concat_ws(".", F.hex(F.xxhash64(text)), F.transform(F.sequence(F.lit(0), F.lit(PARTS * CELLS - 1)), shown))


def summed(rows: DataFrame, keys: list[str], carry: str) -> DataFrame:
    """Rows of one cell as one; cells that hold nothing go."""
    sums = rows.groupBy(*keys, "cells", "place", "tag", carry).agg(F.sum("n").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("c").alias("c"))
    return sums.where((F.col("place") < 0) | (F.col("n") != 0) | (F.col("k") != 0) | (F.col("c") != 0))


def row_of(place: Column, n: Column, k: Column, c: Column, tag: Column, carried: Column) -> Column:
    return F.struct(place.cast("int").alias("place"), n.cast("long").alias("n"), k.alias("k"), c.alias("c"), tag.alias("tag"), carried.alias("carried"))


def exploded(rows: DataFrame, keys: list[str], carry: str, out: Column) -> DataFrame:
    return rows.select(*keys, "cells", F.explode(out).alias("r")).select(*keys, "cells", "r.place", "r.n", "r.k", "r.c", "r.tag", F.col("r.carried").alias(carry))


def differences(versions: DataFrame, keys: list[str], old: str, new: str, carry: str, attempt: int = 0) -> DataFrame:
    """keys, carry, n_old, n_new, removed and added (arrays of the digests that only the old and only the new version holds) and stalled (whether
    peeling left cells, so that the arrays are not all) of every row of versions.

    keys tell the rows apart, carry is any struct to take along; arrays of digests hold each once and are not null. Where versions are
    dealt by one of the keys already, nothing is shuffled.
    """
    none, nothing = F.lit(0).cast("long"), F.lit(None).cast(versions.schema[carry].dataType)
    size = F.greatest(F.lit(float(LEAST)), F.pow(F.lit(2), F.ceil(F.log2((F.size(old) + F.size(new) + 1) * F.lit(SPARE)))))
    sided = F.concat(F.array(F.struct(F.lit(0).alias("n"), none.alias("d"))),
                     F.transform(old, lambda d: F.struct(F.lit(1).alias("n"), d.alias("d"))), F.transform(new, lambda d: F.struct(F.lit(-1).alias("n"), d.alias("d"))))
    rows = (versions.select(*keys, (size * 2**attempt).cast("int").alias("cells"), F.struct(F.col(carry).alias("kept"), F.size(old).alias("n_old"), F.size(new).alias("n_new")).alias(carry), sided.alias("all"))
            .select(*keys, "cells", carry, F.explode("all").alias("e")))
    wide = F.struct(nothing.alias("kept"), F.lit(0).alias("n_old"), F.lit(0).alias("n_new"))
    no_carry = F.when(F.lit(False), wide)
    n, d = F.col("e.n"), F.col("e.d")
    in_cells = F.array(*(row_of(cell(d, part, F.col("cells"), attempt), n, d, check(d), none, no_carry) for part in range(PARTS)))
    rows = summed(exploded(rows, keys, carry, F.when(n == 0, F.array(row_of(F.lit(DOCUMENT), none, none, none, none, F.col(carry)))).otherwise(in_cells)), keys, carry)
    place, n, k, c, cells = (F.col(x) for x in ("place", "n", "k", "c", "cells"))
    for r in range(ROUNDS):
        part = r % PARTS
        alone = (place >= cells * part) & (place < cells * (part + 1)) & (F.abs(n) == 1) & (check(k) == c)
        away = [row_of(cell(k, other, cells, attempt), -n, k, c, none, no_carry) for other in range(PARTS) if other != part]
        found = F.array(row_of(F.lit(FOUND), n, none, none, k, no_carry), *away)
        rows = summed(exploded(rows, keys, carry, F.when(alone, found).otherwise(F.array(row_of(place, n, k, c, F.col("tag"), F.col(carry))))), keys, carry)
    given = lambda sign: F.collect_list(F.when((place == FOUND) & (n == sign), F.col("tag")))       # noqa: E731
    result = rows.groupBy(*keys).agg(F.first(carry, ignorenulls=True).alias("w"), given(1).alias("removed"), given(-1).alias("added"), F.max(place >= CELL).alias("stalled"))
    return result.select(*keys, F.col("w.kept").alias(carry), F.col("w.n_old").alias("n_old"), F.col("w.n_new").alias("n_new"), "removed", "added", "stalled")


def likeness(n_old: Column, n_new: Column, differing: Column) -> Column:
    """Common paragraphs of all different ones, from the sizes and the number of paragraphs that one text has alone; 1 for two texts without any."""
    common = (n_old + n_new - differing) / 2
    return F.when(n_old + n_new == 0, F.lit(1.0)).otherwise(common / (common + differing))


def next_documents(docs: DataFrame) -> tuple[DataFrame, int]:
    """The code points of all texts, and for every different doc_id: id (as text, '' for null), most (half the code points of its longest text), next_id (that of the next smaller doc_id,
    of the largest after the smallest; null is below all) and next_key (hash of the text that stands for it, the smallest). Ids are put in
    order in ranges of about ID_ROWS; across ranges only one row each is ordered."""
    whole = F.coalesce("text", F.lit(""))
    ids = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.floor(F.length(whole) / 2)).alias("most"), F.sum(F.length(whole)).alias("chars"), F.min(F.xxhash64(whole)).alias("key"))
    ids = written(ids)
    count, chars = ids.agg(F.count("*"), F.coalesce(F.sum("chars"), F.lit(0))).first()
    ranges = max(1, -(-count // ID_ROWS))
    ranged = written(ids.repartitionByRange(ranges, F.asc_nulls_first("doc_id")).withColumn("range", F.spark_partition_id()))
    largest = ranged.agg(F.max(F.struct(F.col("doc_id").isNotNull().alias("given"), "doc_id", "key"))).first()[0]
    after = last_before(ranged, [], F.col("range"), F.col("doc_id"), F.struct("doc_id", "key"), "next")
    wrap = F.struct(*(F.lit(largest and largest[c]).cast("long").alias(c) for c in ("doc_id", "key")))
    own = F.coalesce("next", wrap)
    found = after.select(id_text(F.col("doc_id")).alias("id"), F.col("most").cast("int").alias("most"), id_text(own["doc_id"]).alias("next_id"), own["key"].alias("next_key"))
    return found, int(chars)


def id_text(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def edited_pairs(docs: DataFrame) -> DataFrame:
    """id, doc_id, row, text, edited, and the next document's digests (others), for every row of docs, dealt by id."""
    order, chars = next_documents(docs)
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-chars // TASK_CHARS))
    texts = docs.select(id_text(F.col("doc_id")).alias("id"), F.coalesce("text", F.lit("")).alias("text")).repartition(tasks, "id")       # shuffled once for both joins
    wanted = order.select(F.col("next_id").alias("id"), F.col("id").alias("asker"), "most", "next_key")
    # The text that stands for its id, once: equal rows share a task, so dropping all but one shuffles nothing.
    given = texts.join(wanted.hint("merge"), "id").where(F.xxhash64("text").bitwiseXOR(F.col("next_key")) == 0)
    given = given.groupBy("id").agg(F.first(F.struct("asker", "most", "text")).alias("g")).select("g.*")
    parts = given.select(F.col("asker").alias("id"), F.substring("text", F.lit(1), F.col("most")).alias("part"), digests(F.col("text")).alias("others"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("part", F.lit(1), half))
    doc_id = F.when(F.col("id") != "", F.col("id")).cast(docs.schema["doc_id"].dataType)
    return texts.join(parts.hint("merge"), "id").select("id", doc_id.alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text", edited.alias("edited"), "others")


def compared(rows: DataFrame, attempt: int) -> DataFrame:
    """One try for rows of id, row, own, changed, others (digests) and wide (the rest of the result): wide, both likenesses, counts, tries, and for
    rows whose peeling stalled the three arrays again."""
    pairs = F.array(*(F.struct(F.lit(i).alias("pair"), F.col("own").alias("old"), F.col(new).alias("new"), (F.col("carry") if i == 0 else F.lit(None)).alias("carry")) for i, new in enumerate(("changed", "others"))))
    versions = (rows.withColumn("carry", F.struct("wide", "own", "changed", "others")).select("id", "row", F.explode(pairs).alias("p"))
                .select("id", "row", "p.*"))
    found = differences(versions, ["id", "row", "pair"], "old", "new", "carry", attempt)
    near = likeness(F.col("n_old"), F.col("n_new"), F.size("removed") + F.size("added"))
    of = lambda pair, c: F.max(F.when(F.col("pair") == pair, c))      # noqa: E731
    both = found.groupBy("id", "row").agg(
        F.first("carry", ignorenulls=True).alias("c"), of(0, near).alias("near_edited"), of(1, near).alias("near_next"), of(0, F.col("n_old")).alias("n_paragraphs"),
        of(0, F.size("removed")).alias("n_removed"), of(0, F.size("added")).alias("n_added"), F.max("stalled").alias("stalled"))
    again = [F.when(F.col("stalled"), F.col("c")[a]).alias(a) for a in ("own", "changed", "others")]
    return both.select("id", "row", F.col("c.wide").alias("wide"), "near_edited", "near_next", "n_paragraphs", "n_removed", "n_added", F.lit(attempt + 1).alias("tries"), "stalled", *again)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs (doc_id, text; no more columns
    are read), and between a text and its edited one the counts of paragraphs, removed and added, with the number of tables tried.

    Likeness is that of the sets of different paragraphs (lines, cut at sentence ends and after 16 words): repeats of a paragraph and the white space
    around it are not seen. A null text is empty and, like a blank one, has no paragraphs; two such texts are alike. Rows of a repeated doc_id are
    each returned and edited with the same next document, that of the next smaller doc_id, for which the text of smallest hash stands if it
    has several; a null doc_id is below all; a lone doc_id is its own next. Very long texts are more rows of cells. An empty table gives no
    rows. Each try is a written table, and only what stalled in it is tried again.
    """
    rows = edited_pairs(docs).select("id", "row", "doc_id", "text", "edited", "others", digests(F.col("text")).alias("own"), digests(F.col("edited")).alias("changed"))
    wide = F.struct("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("text"), F.col("own")).alias("fingerprint"),
                    fingerprint(F.col("edited"), F.col("changed")).alias("edited_fingerprint"))
    rows = rows.select("id", "row", "own", "changed", "others", wide.alias("wide"))
    tables: list[DataFrame] = []
    while not tables or rows.limit(1).count():
        tables.append(written(compared(rows, len(tables))))
        rows = tables[-1].where("stalled")
    done = reduce(DataFrame.union, (t.where("NOT stalled") for t in tables))
    return done.select("wide.*", "near_edited", "near_next", "n_paragraphs", "n_removed", "n_added", "tries")


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"))
