"""Chunking and classification over the whole corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from prospectra.functions import fixed_values as V
from prospectra.operators import chunking, classify
from prospectra.plans.inputs import check_sql, derived, spread, spread_derived, table
from prospectra.plans.registry import Registry, shared

# pages of four lines
PAGES_SQL = """doc_pages AS (SELECT doc_id, page, array_to_string(l[(page - 1) * 4 + 1 : page * 4], chr(10)) AS text
  FROM (SELECT doc_id, l, unnest(generate_series(1, (len(l) + 3) // 4)) AS page
        FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"""


def _atoms_sql(x: str, size: int, separators) -> str:
    sep, finer = separators[0], separators[1:]
    if sep == "":
        return f"list_filter(string_split({x}, ''), lambda c: c <> '')"
    lit = {"\n\n": "chr(10) || chr(10)", "\n": "chr(10)"}.get(sep, f"'{sep}'")
    p = f"p{len(finer)}"
    pieces = (f"list_filter(list_transform(string_split({x}, {lit}), lambda q{len(finer)}, i{len(finer)}: "
              f"CASE WHEN i{len(finer)} = 1 THEN q{len(finer)} ELSE {lit} || q{len(finer)} END), lambda f{len(finer)}: f{len(finer)} <> '')")
    return (f"CASE WHEN contains({x}, {lit}) THEN flatten(list_transform({pieces}, lambda {p}: CASE WHEN length({p}) < {size} THEN [{p}] "
            f"ELSE list_concat([''], {_atoms_sql(p, size, finer)}, ['']) END)) ELSE {_atoms_sql(x, size, finer)} END")


def chunks_sql(name: str, size: int, overlap: int) -> str:
    """Chunk tables of the checking engine: recursive packing over the atoms of every page."""
    return f"""{PAGES_SQL},
{name}_atoms AS (SELECT doc_id, page, list_concat({_atoms_sql('text', size, V.SEPARATORS)}, ['']) AS atoms FROM doc_pages),
{name}_packed AS (SELECT doc_id, page, list_reduce(atoms, lambda s, a:
   CASE WHEN a = '' THEN {{'cur': []::VARCHAR[], 'out': CASE WHEN len(s.cur) > 0 THEN list_append(s.out, array_to_string(s.cur, '')) ELSE s.out END}}
        WHEN len(s.cur) > 0 AND length(array_to_string(s.cur, '')) + length(a) > {size}
        THEN {{'cur': list_append(s.cur[len(s.cur) - coalesce(list_max(list_filter(generate_series(1, len(s.cur)), lambda n:
               length(array_to_string(s.cur[len(s.cur) - n + 1 :], '')) <= least({overlap}, {size} - length(a)))), 0) + 1 :], a),
              'out': list_append(s.out, array_to_string(s.cur, ''))}}
        ELSE {{'cur': list_append(s.cur, a), 'out': s.out}} END,
   {{'cur': []::VARCHAR[], 'out': []::VARCHAR[]}}).out AS out FROM {name}_atoms),
{name}_flat AS (SELECT doc_id, page, pos, regexp_replace(piece, '^\\s+|\\s+$', '', 'g') AS text FROM (
   SELECT doc_id, page, unnest(out) AS piece, unnest(range(len(out))) AS pos FROM {name}_packed)),
{name} AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, pos) - 1 AS INT) AS chunk_id,
   CAST(page AS INT) AS page, text FROM {name}_flat WHERE text <> '')"""


@shared
def document_pages(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").select("doc_id", chunking.pages_of_lines(F.col("text")).alias("pages"))


@shared
def document_chunks(spark, sf, size=V.GENERAL_CHUNKS[0], overlap=V.GENERAL_CHUNKS[1]):
    return chunking.chunk_pages(document_pages(spark, sf), size, overlap)


KEYWORD_ROWS = ", ".join(f"({i}, '{d}', '{w}')" for i, d in enumerate(V.DOMAINS) for w in V.DOMAIN_KEYWORDS[d])
SCORES_SQL = f"""keywords(ord, domain, word) AS (VALUES {KEYWORD_ROWS}),
hits AS (SELECT doc_id, ord, domain, count(*) AS n FROM {{source}} JOIN keywords ON regexp_matches(lower({{source}}.text), '\\b' || word || '\\b')
   GROUP BY ALL),
by_keywords AS (SELECT s.doc_id, coalesce(arg_max(domain, n * 10 - ord), 'enterprise') AS domain FROM {{source}} s LEFT JOIN hits USING (doc_id) GROUP BY s.doc_id)"""


def register(r: Registry) -> None:
    for name, (size, overlap) in {"chunk_pages": V.GENERAL_CHUNKS, "chunk_offer_pages": V.OFFER_CHUNKS}.items():
        r.add(name, lambda spark, sf, size=size, overlap=overlap: document_chunks(spark, sf, size, overlap),
              f"WITH {chunks_sql('chunks', size, overlap)} SELECT doc_id, chunk_id, page, text FROM chunks")

    r.add("chunk_fixed", lambda spark, sf: chunking.chunk_fixed(
        table(spark, sf, "documents").select("doc_id", "text"), *V.GENERAL_CHUNKS), """
        WITH w AS (SELECT doc_id, text, unnest(generate_series(0, CASE WHEN length(text) <= 500 THEN 0
              ELSE CAST(ceil((length(text) - 50) / 450.0) AS BIGINT) - 1 END)) AS i FROM documents),
        c AS (SELECT doc_id, i, regexp_replace(text[i * 450 + 1 : i * 450 + 500], '^\\s+|\\s+$', '', 'g') AS text FROM w)
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS chunk_id, text FROM c WHERE text <> ''""")

    r.add("classify_by_keywords", lambda spark, sf: spread_derived(spark, sf, "domain_texts", "documents", "doc_id").select(
        "doc_id", *[s.alias(d) for d, s in classify.domain_scores(F.col("text")).items()]).select(
        "*", classify.best_domain({d: F.col(d) for d in V.DOMAINS}).alias("domain")), f"""
        WITH {check_sql('domain_texts')}, {SCORES_SQL.format(source='domain_texts')}
        SELECT t.doc_id, {', '.join(f"CAST(coalesce(max(CASE WHEN h.domain = '{d}' THEN n END), 0) AS INT) AS {d}" for d in V.DOMAINS)},
               any_value(b.domain) AS domain
        FROM domain_texts t LEFT JOIN hits h USING (doc_id) JOIN by_keywords b ON b.doc_id = t.doc_id GROUP BY t.doc_id""")

    r.add("parse_label", lambda spark, sf: derived(spark, sf, "label_replies").select(
        "doc_id", classify.parse_label(F.col("reply")).alias("domain")), f"""
        WITH {check_sql('label_replies')},
        named AS (SELECT doc_id, list_filter(['legal', 'finance', 'healthcare', 'enterprise'],
                  lambda d: list_contains(regexp_extract_all(lower(reply), '[a-z]+'), d)) AS n FROM label_replies)
        SELECT doc_id, CASE WHEN len(n) = 1 THEN n[1] END AS domain FROM named""")

    def resolved(spark, sf):
        texts = spread_derived(spark, sf, "domain_texts", "documents", "doc_id")
        scores = classify.domain_scores(F.col("text"))
        scored = texts.select("doc_id", *[s.alias(d) for d, s in scores.items()])
        by_keywords = classify.best_domain({d: F.col(d) for d in V.DOMAINS})
        joined = scored.join(derived(spark, sf, "label_replies"), "doc_id", "left")
        domain, how = classify.resolve_domain(F.col("chosen"), classify.parse_label(F.col("reply")), by_keywords)
        return joined.select("doc_id", domain.alias("domain"), how.alias("detected_by"))

    r.add("resolve_domain", resolved, f"""
        WITH {check_sql('domain_texts', 'label_replies')}, {SCORES_SQL.format(source='domain_texts')},
        named AS (SELECT doc_id, chosen, list_filter(['legal', 'finance', 'healthcare', 'enterprise'],
                  lambda d: list_contains(regexp_extract_all(lower(reply), '[a-z]+'), d)) AS n FROM label_replies)
        SELECT b.doc_id, coalesce(chosen, CASE WHEN len(n) = 1 THEN n[1] END, b.domain) AS domain,
               CASE WHEN chosen IS NOT NULL THEN 'user' WHEN len(n) = 1 THEN 'llm' ELSE 'keywords' END AS detected_by
        FROM by_keywords b LEFT JOIN named USING (doc_id)""")
