"""Sections and chunks over lines that suppliers write and over ``documents``' lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketspark.operators import sections as S
from docketspark.plans.registry import query
from docketspark.plans.text import each, each_sql, every, every_sql
from docketspark.session import spread, table

_LINES = [
    (1, 0, "CITY SIGN BYLAW", 1, 10.0, False),
    (1, 1, "PART IV — GENERAL", 1, 10.0, False),
    (1, 2, "This part is general.", 1, 10.0, False),
    (1, 3, "5.3 Fascia Signs #", 1, 10.0, False),
    (1, 4, "5.3 metres from the property line", 1, 10.0, False),
    (1, 5, "(a) placed on # walls", 2, 10.0, False),
    (1, 6, "(b) lit from inside", 2, 10.0, False),
    (1, 7, "more of b", 2, 10.0, False),
    (1, 8, "(iii) never moving", 2, 10.0, False),
    (1, 9, "Page 3", 3, 10.0, False),
    (1, 10, "5.3.1 Maximum Area", 3, 10.0, False),
    (1, 11, "A sign shall not exceed #.3 m2.", 3, 10.0, False),
    (1, 12, "SCHEDULE A — MAXIMUM SIGN AREA", 4, 10.0, False),
    (1, 13, "Appendices and other things", 4, 12.0, True),
    (1, 14, "text of the schedule", 4, 10.0, False),
    (2, 0, "No heading at all.", 1, 10.0, False),
]
_SECTIONS = [
    (1, 0, "Part 4", "GENERAL", 1, -1, "Part 4", 1, 1, 0, "This part is general."),
    (1, 1, "5.3", "Fascia Signs #", 3, 0, "Part 4 > 5.3", 1, 1, 0, "5.3 metres from the property line"),
    (1, 2, "(a)", "placed on # walls", 4, 1, "Part 4 > 5.3 > (a)", 2, 2, 0, ""),
    (1, 3, "(b)", "lit from inside", 4, 1, "Part 4 > 5.3 > (b)", 2, 2, 1, "more of b"),
    (1, 4, "(iii)", "never moving", 5, 3, "Part 4 > 5.3 > (b) > (iii)", 2, 3, 0, "Page 3"),
    (1, 5, "5.3.1", "Maximum Area", 4, 1, "Part 4 > 5.3 > 5.3.1", 3, 3, 2, "A sign shall not exceed #.3 m2."),
    (1, 6, "Schedule A", "MAXIMUM SIGN AREA", 1, -1, "Schedule A", 4, 4, 1, ""),
    (1, 7, "", "Appendices and other things", 2, 6, "Schedule A > Appendices and other things", 4, 4, 0, "text of the schedule"),
]
_SCHEMA = "doc_id long, line_no int, text string, page_number int, font_size double, is_bold boolean"


@query(f"SELECT key * 10 + doc AS doc_id, idx, section_number, heading, level, parent_index, full_path, page_start, page_end, ordinal, body FROM {every_sql('doc, idx, section_number, heading, level, parent_index, full_path, page_start, page_end, ordinal, body', *_SECTIONS)}", doc_id="BIGINT", idx="BIGINT")
def section_tree(spark, d):
    """The tree of every supplier's small bylaw: siblings stay siblings, text before the first heading belongs to none."""
    lines = every(spark, d, _SCHEMA, *_LINES)
    return S.parse_sections(lines.withColumn("doc_id", F.col("key") * 10 + F.col("doc_id")).drop("key"))


_HEADS = [
    ("PART IV — GENERAL", "part", "Part 4", "GENERAL", 1),
    ("DIVISION 2 Signs", "division", "Division 2", "Signs", 2),
    ("Appendix B2: Tables", "schedule", "Schedule B2", "Tables", 1),
    ("5.3.# Maximum Area", "numbered", "5.3.#", "Maximum Area", 4),
    ("5.3 metres from the line", None, None, None, None),
    ("7 Section 4 applies", None, None, None, None),
    ("12 Signs and", None, None, None, None),
    ("(a) first #", "alpha", "(a)", "first #", 90),
    ("(iv) second", "alpha", "(iv)", "second", 90),
    ("(xiv) third", "roman", "(xiv)", "third", 91),
    ("Page #", None, None, None, None),
    ("plain words", None, None, None, None),
]


@query(f"SELECT key, kind, number, heading, CAST(level AS INTEGER) AS level FROM {each_sql('kind, number, heading, level', *[x[1:] for x in _HEADS])}")
def heading_forms(spark, d):
    """Heading forms and what only looks like one, in lines that customers' numbers stand in."""
    return each(spark, d, "line string", *[x[:1] for x in _HEADS]).select("key", S.heading(F.col("line")).alias("h")).select("key", "h.kind", "h.number", "h.heading", "h.level")


def _n(x: str) -> str:
    return f"CAST(greatest(1, round_even(length({x}) / 3.6, 0)) AS INTEGER)"


_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(rf"""WITH RECURSIVE b AS (SELECT doc_id, '[1 ' || source || ']' || chr(10) AS prefix, trim(text, {_BLANK}) AS body FROM documents WHERE trim(coalesce(text, ''), {_BLANK}) <> ''),
       pa AS (SELECT doc_id, pi, trim(p, {_BLANK}) AS p FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS pi FROM (SELECT doc_id, string_split_regex(body, '\n\s*\n') AS ps FROM b WHERE {_n('body')} > 400)) WHERE trim(p, {_BLANK}) <> ''),
       se AS (SELECT doc_id, pi, 0 AS si, p AS unit FROM pa WHERE {_n('p')} <= 200
              UNION ALL SELECT doc_id, pi, generate_subscripts(ss, 1), trim(unnest(ss), {_BLANK}) FROM (SELECT doc_id, pi, string_split(regexp_replace(p, '([.!?])\s+([A-Z(])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS ss FROM pa WHERE {_n('p')} > 200)),
       u AS (SELECT doc_id, row_number() OVER w AS k, unit, {_n('unit')} AS n, sum({_n('unit')}) OVER w AS c FROM se WHERE unit <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY pi, si)),
       cs AS (SELECT doc_id, list(c ORDER BY k) AS c FROM u GROUP BY 1),
       f AS (SELECT doc_id, 0::BIGINT AS k, 1::BIGINT AS a, 0::BIGINT AS z, false AS fresh, 0::BIGINT AS ea, 0::BIGINT AS ez FROM cs
             UNION ALL
             SELECT doc_id, k, CASE WHEN n > 400 THEN k + 1 WHEN flush THEN coalesce(list_max(list_filter(range(a, z + 1), lambda x: c[z] - coalesce(c[x - 1], 0) > 20)), a) ELSE a END, CASE WHEN n > 400 THEN k ELSE k END, n <= 400,
                    CASE WHEN (flush OR n > 400) AND fresh AND z >= a THEN a ELSE 0 END, CASE WHEN (flush OR n > 400) AND fresh AND z >= a THEN z ELSE 0 END
             FROM (SELECT f.doc_id, u.k, u.n, f.a, f.z, f.fresh, cs.c, f.z >= f.a AND (cs.c[f.z] - coalesce(cs.c[f.a - 1], 0)) + u.n > 200 AS flush FROM f JOIN u ON u.doc_id = f.doc_id AND u.k = f.k + 1 JOIN cs ON cs.doc_id = f.doc_id)),
       e AS (SELECT doc_id, k, 0 AS part, ea, ez FROM f WHERE ez > 0
             UNION ALL SELECT doc_id, k + 1, 0, a, z FROM f WHERE fresh AND z >= a QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k DESC) = 1 AND k = (SELECT max(k) FROM u WHERE u.doc_id = f.doc_id)),
       w AS (SELECT doc_id, k, n, list_filter(string_split_regex(unit, '\s+'), lambda x: x <> '') AS ws FROM u WHERE n > 400),
       h AS (SELECT doc_id, k, unnest(range(0, len(ws), st)) AS x, ws, st FROM (SELECT doc_id, k, ws, greatest(1, CAST(floor(len(ws) * 200 / n::DOUBLE) AS BIGINT)) AS st FROM w)),
       pk AS (SELECT e.doc_id, e.k, 0 AS part, string_agg(unit, ' ' ORDER BY u.k) AS body FROM e JOIN u ON u.doc_id = e.doc_id AND u.k BETWEEN e.ea AND e.ez GROUP BY 1, 2, 3
              UNION ALL SELECT doc_id, k, 1 + x, array_to_string(ws[x + 1 : x + st], ' ') FROM h),
       o AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, part) AS i, body, {_n('body')} AS n FROM pk),
       m AS (SELECT doc_id, i, body, n, 1 AS chunk FROM o WHERE i = 1
             UNION ALL SELECT doc_id, i, CASE WHEN joins THEN body || ' ' || more ELSE more END, CASE WHEN joins THEN {_n("body || ' ' || more")} ELSE more_n END, CASE WHEN joins THEN chunk ELSE chunk + 1 END
             FROM (SELECT m.doc_id, o.i, m.body, o.body AS more, o.n AS more_n, m.chunk, o.n < 25 AND m.n + o.n <= 400 AS joins FROM m JOIN o ON o.doc_id = m.doc_id AND o.i = m.i + 1)),
       r AS (SELECT doc_id, chunk, last(body ORDER BY i) AS body, last(n ORDER BY i) AS n FROM m GROUP BY 1, 2),
       many AS (SELECT doc_id FROM o GROUP BY 1 HAVING count(*) > 1)
       SELECT doc_id, 0 AS ordinal, {_n('body')} AS token_count, 'prose' AS chunk_type, sha256(prefix || body) AS hash FROM b WHERE {_n('body')} <= 400
       UNION ALL SELECT doc_id, 0, {_n('body')}, 'parent', sha256(prefix || body) FROM b WHERE doc_id IN (FROM many)
       UNION ALL SELECT doc_id, CASE WHEN doc_id IN (FROM many) THEN chunk ELSE chunk - 1 END, r.n, 'prose', sha256(prefix || r.body) FROM r JOIN b USING (doc_id)""", ordinal="INTEGER", token_count="INTEGER")
def section_chunks(spark, d):
    """Every document's lines as one section's body, cut into chunks: parents, packed pieces with overlap, hard cuts, merged tails."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text", "source"))
    whole = docs.select("doc_id", F.lit(0).cast("long").alias("idx"), F.lit("1").alias("section_number"), F.col("source").alias("heading"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), F.coalesce("text", F.lit("")).alias("body"))
    return S.chunk_sections(whole, target=200, most=400, overlap=20).select("doc_id", "ordinal", "token_count", "chunk_type", F.sha2("body", 256).alias("hash"))


@query("""WITH RECURSIVE l AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, CAST(greatest(1, round_even(length(line) / 3.6, 0)) AS INTEGER) AS n
         FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE line <> ''),
       g AS (SELECT doc_id, k, n AS held, 0 AS ordinal FROM l WHERE k = 1
             UNION ALL SELECT l.doc_id, l.k, CASE WHEN held + n > 150 THEN n ELSE held + n END, CASE WHEN held + n > 150 THEN ordinal + 1 ELSE ordinal END FROM g JOIN l ON l.doc_id = g.doc_id AND l.k = g.k + 1)
       SELECT g.doc_id AS id, CAST(ordinal AS INTEGER) AS ordinal, CAST(greatest(1, round_even(length(string_agg(line, ' ' ORDER BY g.k)) / 3.6, 0)) AS INTEGER) AS n_tokens, sha256(string_agg(line, ' ' ORDER BY g.k)) AS hash
       FROM g JOIN l ON l.doc_id = g.doc_id AND l.k = g.k GROUP BY 1, 2""")
def greedy_chunks(spark, d):
    """Lines packed greedily to 150 tokens."""
    return S.greedy_chunks(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text", 150).select("id", "ordinal", "n_tokens", F.sha2("body", 256).alias("hash"))
