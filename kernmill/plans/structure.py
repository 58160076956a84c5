"""Queries of problems 1, 2 and 5 and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kernmill.operators import hierarchy, hotkeys, nested


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _raw(spark, sf):
    return _read(spark, sf, "merged_raw")


def p1_found(spark, sf):
    return nested.usable_entries(_raw(spark, sf))


def p1_entities(spark, sf):
    return nested.shred(_raw(spark, sf), "entities").select(
        "line_no", "qid", "pid", "title", "name", F.array_join("aka", "|", "").alias("aka"), "desc"
    )


def p1_sentences(spark, sf):
    return nested.shred(_raw(spark, sf), "sentences").drop("dewey", "parent")


def p1_links(spark, sf):
    """Usable link entries with their own label and that of the map or array they stand in."""
    return nested.shred(_raw(spark, sf), "links").where("usable").drop("usable")


def p1_contexts(spark, sf):
    """Usable contexts entries with their own label and that of the array they stand in."""
    return nested.shred(_raw(spark, sf), "contexts").where("usable").drop("usable")


def p1_aliases(spark, sf):
    return nested.shred(_raw(spark, sf), "aliases")


def p1_triples(spark, sf):
    return nested.shred(_raw(spark, sf), "triples")


def p1_nodes(spark, sf):
    return nested.shred(_raw(spark, sf), "nodes")


def _profile(spark, sf):
    return hotkeys.entity_profile(_read(spark, sf, "merged"))


def p2_found(spark, sf):
    return hotkeys.heavy_entities(_profile(spark, sf))


def p2_profile(spark, sf):
    return _profile(spark, sf).select("field", "qid", "n_entries", "n_records", "first_rec", "last_rec", "max_gap")


def _forest(spark, sf):
    return hierarchy.build_forest(hierarchy.property_edges(_read(spark, sf, "subprops")))


def p5_found(spark, sf):
    return hierarchy.roots_and_depths(_forest(spark, sf))


def p5_nodes(spark, sf):
    forest = _forest(spark, sf)
    return hierarchy.node_paths(forest, hierarchy.labelled_chains(forest)).select(
        "prop", "parent", "status", "subtree_size", F.array_join("path", "/").alias("path")
    )


def p5_descendants(spark, sf):
    return hierarchy.descendants(hierarchy.labelled_chains(_forest(spark, sf)))


QUERIES = {
    "p1_found": p1_found,
    "p1_entities": p1_entities,
    "p1_sentences": p1_sentences,
    "p1_links": p1_links,
    "p1_contexts": p1_contexts,
    "p1_aliases": p1_aliases,
    "p1_triples": p1_triples,
    "p1_nodes": p1_nodes,
    "p2_found": p2_found,
    "p2_profile": p2_profile,
    "p5_found": p5_found,
    "p5_nodes": p5_nodes,
    "p5_descendants": p5_descendants,
}

_P1 = """
WITH raw AS (
  SELECT line_no, TRY_CAST(line AS JSON) AS v FROM merged_raw
  WHERE line IS NOT NULL AND trim(line) <> '' AND json_valid(line)
), rec AS (
  SELECT line_no, CASE WHEN json_exists(v, 'qid') THEN v ELSE coalesce(v->'data'->'entity', v->'record', v) END AS e
  FROM raw WHERE json_type(v) = 'OBJECT'
), paras AS (
  SELECT line_no, unnest(range(json_array_length(e->'text')::BIGINT)) AS para_no, e->'text' AS txt
  FROM rec WHERE json_type(e->'text') = 'ARRAY'
), para AS (
  SELECT line_no, para_no, txt->para_no AS p FROM paras
), plist AS (
  SELECT line_no, para_no, CASE json_type(p) WHEN 'ARRAY' THEN p WHEN 'OBJECT' THEN p->'sents' ELSE NULL END AS l FROM para
), sents AS (
  SELECT line_no, para_no, sent_no,
    CASE json_type(l->sent_no) WHEN 'VARCHAR' THEN l->>sent_no WHEN 'OBJECT' THEN l->sent_no->>'s' END AS sentence
  FROM (SELECT *, unnest(range(json_array_length(l)::BIGINT)) AS sent_no FROM plist WHERE json_type(l) = 'ARRAY')
  UNION ALL
  SELECT line_no, para_no, 0, p->>'$' FROM para WHERE json_type(p) = 'VARCHAR'
), sentences AS (
  SELECT line_no, para_no, sent_no, sentence,
    len(list_filter(string_split_regex(sentence, '\\s+'), lambda x: x <> '')) AS n_tokens FROM sents
)
"""

_P1_ENTRIES = (
    _P1
    + """
, keys AS (
  SELECT line_no, e, list_position(json_keys(e), 'link') - 1 AS lk_at, list_position(json_keys(e), 'contexts') - 1 AS cx_at FROM rec
), lk AS (
  SELECT line_no, lk_at, i - 1 AS i, map_keys(m)[i] AS child_key, map_values(m)[i] AS x
  FROM (SELECT line_no, lk_at, m, unnest(range(1, len(map_keys(m)) + 1)) AS i FROM
    (SELECT line_no, lk_at, CAST(e->'link' AS MAP(VARCHAR, JSON)) AS m FROM keys WHERE json_type(e->'link') = 'OBJECT'))
  UNION ALL
  SELECT line_no, lk_at, i - 1 AS i, l[i]->>'target', l[i] FROM
    (SELECT line_no, lk_at, l, unnest(range(1, len(l) + 1)) AS i FROM
      (SELECT line_no, lk_at, CAST(e->'link' AS JSON[]) AS l FROM keys WHERE json_type(e->'link') = 'ARRAY'))
), pos AS (
  SELECT line_no, lk_at || '.' || i AS dewey, CAST(lk_at AS VARCHAR) AS parent, child_key,
    TRY_CAST(coalesce(x->>'para', x->'at'->>'para', x->>'$[0]') AS BIGINT) AS para_no,
    TRY_CAST(coalesce(x->>'sent', x->'at'->>'sent', x->>'$[1]') AS BIGINT) AS sent_no,
    TRY_CAST(coalesce(x->'span'->>'begin', x->'span'->>'$[0]', x->>'$[2][0]', x->>'$[2]') AS BIGINT) AS tok_begin,
    TRY_CAST(coalesce(x->'span'->>'end', x->'span'->>'$[1]', x->>'$[2][1]', x->>'$[3]') AS BIGINT) AS tok_end
  FROM lk
), links AS (
  SELECT p.*, n_tokens FROM pos p JOIN sentences s ON p.line_no = s.line_no AND p.para_no = s.para_no AND p.sent_no = s.sent_no
  WHERE 0 <= tok_begin AND tok_begin <= tok_end AND tok_end < n_tokens
), cx AS (
  SELECT line_no, cx_at, i, (e->'contexts')->i AS x FROM
    (SELECT line_no, cx_at, e, unnest(range(json_array_length(e->'contexts')::BIGINT)) AS i FROM keys WHERE json_type(e->'contexts') = 'ARRAY')
), cpos AS (
  SELECT line_no, cx_at || '.' || i AS dewey, CAST(cx_at AS VARCHAR) AS parent, CAST(i AS BIGINT) AS ctx_no,
    coalesce(x->>'sentence', x->>'$[0]') AS sentence,
    TRY_CAST(coalesce(x->'span'->>'begin', x->'span'->>'$[0]', x->>'$[1][0]', x->>'$[1]') AS BIGINT) AS tok_begin,
    TRY_CAST(coalesce(x->'span'->>'end', x->'span'->>'$[1]', x->>'$[1][1]', x->>'$[2]') AS BIGINT) AS tok_end
  FROM cx
), ctx AS (
  SELECT *, len(list_filter(string_split_regex(sentence, '\\s+'), lambda x: x <> '')) AS n_tokens FROM cpos
), contexts AS (SELECT * FROM ctx WHERE 0 <= tok_begin AND tok_begin <= tok_end AND tok_end < n_tokens)
"""
)

_P1_FOUND = (
    _P1_ENTRIES
    + """
SELECT line_no, 'link' AS field, child_key, para_no, sent_no, tok_begin, tok_end FROM links
UNION ALL
SELECT line_no, 'contexts', CAST(ctx_no AS VARCHAR), CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), tok_begin, tok_end FROM contexts
"""
)

_P2 = """
WITH e AS (
  SELECT 'link' AS field, unnest(map_keys(link)) AS qid, rec_id FROM merged
  UNION ALL
  SELECT 'contexts', qid, rec_id FROM (SELECT qid, rec_id, unnest(contexts) AS c FROM merged)
)
"""

_P5 = """
WITH RECURSIVE edge AS (
  SELECT s AS child, min(o) AS parent FROM subprops
  WHERE starts_with(s, 'P') AND starts_with(o, 'P') GROUP BY s
), node AS (
  SELECT DISTINCT unnest([s, o]) AS prop FROM subprops WHERE starts_with(s, 'P') AND starts_with(o, 'P')
), walk AS (
  SELECT prop, prop AS root, CAST(0 AS BIGINT) AS depth, prop AS path FROM node
  WHERE prop NOT IN (SELECT child FROM edge)
  UNION ALL
  SELECT e.child, w.root, w.depth + 1, w.path || '/' || e.child FROM walk w JOIN edge e ON e.parent = w.prop
)
"""

ORACLE = {
    "p1_found": _P1_FOUND,
    "p1_sentences": _P1 + "SELECT line_no, para_no, sent_no, sentence, n_tokens FROM sentences",
    "p1_entities": _P1
    + """
SELECT line_no, e->>'qid' AS qid, e->>'pid' AS pid, e->>'title' AS title, e->>'name' AS name,
  CASE WHEN json_type(e->'aka') = 'ARRAY' THEN coalesce(array_to_string(CAST(e->'aka' AS VARCHAR[]), '|'), '') END AS aka,
  e->>'desc' AS "desc"
FROM rec""",
    "p1_links": _P1_ENTRIES + "SELECT line_no, dewey, parent, child_key AS target, para_no, sent_no, tok_begin, tok_end FROM links",
    "p1_contexts": _P1_ENTRIES + "SELECT line_no, dewey, parent, ctx_no, sentence, n_tokens, tok_begin, tok_end FROM contexts",
    "p1_aliases": _P1
    + """
, k AS (SELECT line_no, e, list_position(json_keys(e), 'aka') - 1 AS aka_at FROM rec WHERE json_type(e->'aka') = 'ARRAY')
SELECT line_no, aka_at || '.' || i AS dewey, CAST(aka_at AS VARCHAR) AS parent, CAST(i AS BIGINT) AS alias_no, (e->'aka')->>i AS alias
FROM (SELECT *, unnest(range(json_array_length(e->'aka')::BIGINT)) AS i FROM k)""",
    "p1_triples": _P1
    + """
, k AS (SELECT line_no, e, list_position(json_keys(e), 'triples') - 1 AS t_at FROM rec WHERE json_type(e->'triples') = 'ARRAY')
SELECT line_no, t_at || '.' || i AS dewey, CAST(t_at AS VARCHAR) AS parent, CAST(i AS BIGINT) AS triple_no,
  coalesce(x->>'subj', x->>'$[0]') AS subj, coalesce(x->>'rel', x->>'$[1]') AS rel, coalesce(x->>'obj', x->>'$[2]') AS obj
FROM (SELECT line_no, t_at, i, (e->'triples')->i AS x FROM (SELECT *, unnest(range(json_array_length(e->'triples')::BIGINT)) AS i FROM k))""",
    "p2_found": _P2
    + """
SELECT field, qid FROM e GROUP BY field, qid
HAVING qid IS NOT NULL AND count(*) * 100 >= 3 * (SELECT count(*) FROM e e2 WHERE e2.field = e.field)""",
    "p2_profile": _P2
    + """
, g AS (SELECT *, rec_id - lag(rec_id) OVER (PARTITION BY field, qid ORDER BY rec_id) AS gap FROM e)
SELECT field, qid, count(*) AS n_entries, count(DISTINCT rec_id) AS n_records, min(rec_id) AS first_rec,
  max(rec_id) AS last_rec, max(gap) AS max_gap FROM g GROUP BY field, qid""",
    "p5_found": _P5
    + """
SELECT n.prop, coalesce(w.root, 'cycle') AS root, coalesce(w.depth, -1) AS depth
FROM node n LEFT JOIN walk w ON n.prop = w.prop""",
    "p5_nodes": _P5
    + """
, anc AS (SELECT unnest(string_split(path, '/')) AS prop FROM walk),
sizes AS (SELECT prop, count(*) AS subtree_size FROM anc GROUP BY prop),
orbit AS (
  SELECT child AS src, parent AS dst FROM edge WHERE child NOT IN (SELECT prop FROM walk)
  UNION
  SELECT o.src, e.parent FROM orbit o JOIN edge e ON e.child = o.dst
)
SELECT n.prop, e.parent,
  CASE WHEN w.prop IS NOT NULL THEN 'tree'
       WHEN n.prop IN (SELECT src FROM orbit WHERE src = dst) THEN 'loop' ELSE 'below_loop' END AS status,
  s.subtree_size, w.path
FROM node n LEFT JOIN edge e ON e.child = n.prop LEFT JOIN walk w ON w.prop = n.prop
LEFT JOIN sizes s ON s.prop = n.prop""",
    "p5_descendants": _P5
    + """
SELECT a AS prop, prop AS descendant FROM (SELECT prop, unnest(string_split(path, '/')) AS a FROM walk) WHERE a <> prop""",
}
