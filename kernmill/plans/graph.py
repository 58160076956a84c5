"""Knowledge-graph queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kernmill.functions import text as X
from kernmill.operators import entities as E
from kernmill.operators.skew import number_rows
from kernmill.session import new_path
from kernmill.sources import readers

BASE = "http://kg.example.org/"


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _triples(spark, sf):
    return _read(spark, sf, "triples").select("pos", "subj", "rel", "obj")


def _edge_lines(spark, sf):
    """The triples as N-Triples lines; a null part leaves an IRI without id."""
    iri = lambda d, c: F.concat(F.lit(f"<{BASE}{d}/"), F.coalesce(c, F.lit("none")), F.lit(">"))
    return _triples(spark, sf).select("pos", F.concat_ws(" ", iri("entity", F.col("subj")), iri("prop", F.col("rel")), iri("entity", F.col("obj")), F.lit(".")).alias("value"))


def nt_parse_edges(spark, sf):
    return E.edges(E.parse_ntriples(_edge_lines(spark, sf)))


def _literal_lines(spark, sf):
    """Names, descriptions and aliases of items as literal lines, with a language tag by field."""
    d = _read(spark, sf, "items").select("row_id", "qid", "name", "desc", "aka")
    line = lambda rel, v, tag: F.concat(F.lit(f"<{BASE}entity/"), F.col("qid"), F.lit(f"> {rel} \""), v, F.lit(f"\"@{tag} ."))
    parts = F.array(
        F.struct(F.lit(0).alias("k"), line(X.NAME_REL, F.col("name"), "en").alias("value")),
        F.struct(F.lit(1).alias("k"), line(X.DESC_REL, F.col("desc"), "en-gb").alias("value")),
        F.struct(F.lit(2).alias("k"), line(X.DESC_REL, F.col("desc"), "fr").alias("value")),
    )
    akas = F.transform(F.coalesce("aka", F.array().cast("array<string>")), lambda a, i: F.struct((i + 3).alias("k"), line(X.AKA_REL, a, "en").alias("value")))
    return (
        d.select("row_id", F.explode(F.concat(parts, akas)).alias("l"))
        .where("l.value is not null")
        .select((F.col("row_id") * 1000 + F.col("l.k")).alias("pos"), "l.value")
    )


def nt_parse_values(spark, sf):
    return E.literals(E.parse_ntriples(_literal_lines(spark, sf)))


def nt_strict_language(spark, sf):
    return E.literals(E.parse_ntriples(_literal_lines(spark, sf)), strict_lang=True)


def desc_preprocess(spark, sf):
    return _read(spark, sf, "items").select("row_id", X.squeeze(X.short_description(F.col("desc"))).alias("short"))


def triple_freq(spark, sf):
    return E.triple_frequency(_triples(spark, sf))


def items_by_freq(spark, sf):
    return E.by_frequency(triple_freq(spark, sf).where(~E.is_property()))


def top_items(spark, sf):
    return E.ranked(triple_freq(spark, sf).where(~E.is_property()), 50)


def top_props(spark, sf):
    return E.ranked(triple_freq(spark, sf).where(E.is_property()), 50)


def _entities(spark, sf):
    return E.assemble(nt_parse_values(spark, sf), triple_freq(spark, sf))


def entity_assemble(spark, sf):
    return _entities(spark, sf).withColumn("aka", F.array_join("aka", "|"))


def complete_entities(spark, sf):
    d = _entities(spark, sf)
    return d.where(E.complete(["name", "desc", "aka"], dict(d.dtypes))).withColumn("aka", F.array_join("aka", "|"))


def complete_named(spark, sf):
    d = _entities(spark, sf)
    return d.where(E.complete(["name"], dict(d.dtypes))).select("qid", "name")


def dict_last_wins(spark, sf):
    d = _read(spark, sf, "items").withColumn("triple", F.col("freq.triple"))
    return E.last_values(d, "qid", "row_id", ["row_id", "name", "desc", "triple"])


def last_present(spark, sf):
    return E.last_present(_read(spark, sf, "properties"), "qid", "row_id", ["name", "desc"])


def relations_by_pair(spark, sf):
    return E.relations_by_pair(_triples(spark, sf)).withColumn("rels", F.array_join("rels", ","))


def degrees(spark, sf):
    return E.degrees(_triples(spark, sf))


def _in_files(df: DataFrame, order: str, write, name: str, files: int = 5) -> str:
    """Write ``df`` as ``files`` files whose names follow ``order``; the middle ones are the largest."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    ends = df.agg(F.min(order).alias("a"), F.max(order).alias("b")).first()
    share = (F.col(order) - F.lit(ends["a"])) / F.lit(max(1, (ends["b"] or 0) - (ends["a"] or 0)))
    cut = F.least(F.floor(F.sqrt(share) * files), F.lit(files - 1))
    placed = df.withColumn("_file", cut).repartition(files, "_file").sortWithinPartitions("_file", order)
    write(placed, path)
    return path


def _json_folders(df: DataFrame, path: str) -> None:
    df.write.partitionBy("_file").json(path)


def row_cap(spark, sf):
    """The first 500 triples of several files, through the reader's cap."""
    path = _in_files(_triples(spark, sf).withColumnRenamed("pos", "n"), "n", _json_folders, "capped")
    schema = T.StructType.fromDDL("n bigint, subj string, rel string, obj string")
    return readers.read_jsonlines(spark, f"{path}/*", schema, 500).select(F.col("n").alias("pos"), "subj", "rel", "obj")


def file_last_wins(spark, sf):
    """The last record of each id over several files, whatever their sizes."""
    path = _in_files(_read(spark, sf, "items").select("row_id", "qid", "name", "desc"), "row_id", _json_folders, "last")
    rows = readers.read_jsonlines(spark, f"{path}/*", T.StructType.fromDDL("qid string, row_id bigint, name string, `desc` string"))
    return readers.last_by_id(rows.where("qid is not null"))


def nt_file_edges(spark, sf):
    """Edges of N-Triples files, numbered by their place in the files."""
    path = _in_files(_edge_lines(spark, sf), "pos", lambda d, p: d.select("_file", "value").write.partitionBy("_file").text(p), "nt")
    found = E.edges(E.parse_ntriples(readers.read_ntriples(spark, f"{path}/*")))
    return number_rows(found, [], ["pos"]).select(F.col("_rank").alias("place"), "subj", "rel", "obj")


def subprop_file(spark, sf):
    """Property edges of a white-space separated file."""
    path = new_path(spark, "subprops")
    word = lambda c: F.coalesce(F.regexp_replace(c, r"\s+", "_"), F.lit("-"))
    d = _read(spark, sf, "subprops").select(F.concat_ws(" ", *[word(F.col(c)) for c in ("s", "rel", "o")]).alias("value"))
    d.write.text(path)
    return readers.read_subproperties(spark, path)


def _subgraph(spark, sf):
    f = triple_freq(spark, sf)
    return E.subgraph(f.where(~E.is_property()), f.where(E.is_property()), _triples(spark, sf), 1000, 30)


def subgraph(spark, sf):
    return _subgraph(spark, sf)["triples"]


def subgraph_items(spark, sf):
    g = _subgraph(spark, sf)
    names = E.last_values(_read(spark, sf, "items"), "qid", "row_id", ["name", "desc", "aka"])
    line = F.concat_ws("\t", "qid", F.coalesce("name", F.lit("")), F.col("freq").cast("string"), F.coalesce("desc", F.lit("")), F.coalesce(F.array_join("aka", ","), F.lit("")))
    return g["items"].join(names, "qid", "left").select("qid", line.alias("line"))


def subgraph_props(spark, sf):
    return _subgraph(spark, sf)["props"]


def unused_entities(spark, sf):
    """Item ids that stand in no triple."""
    used = _triples(spark, sf).select(F.explode(F.array("subj", "obj")).alias("qid"))
    return _read(spark, sf, "items").select("qid").distinct().join(used, "qid", "left_anti")


def shared_ids(spark, sf):
    """Ids that are both subject and object, and both used and described."""
    t = _triples(spark, sf)
    both = t.select(F.col("subj").alias("qid")).intersect(t.select(F.col("obj").alias("qid")))
    return both.intersect(_read(spark, sf, "items").select("qid"))


def subprop_edges(spark, sf):
    return _read(spark, sf, "subprops").where(F.col("s").startswith("P") & F.col("o").startswith("P")).select("edge_id", "s", "o")


QUERIES = {f.__name__: f for f in (
    nt_parse_edges, nt_parse_values, nt_strict_language, desc_preprocess, triple_freq, items_by_freq, top_items, top_props, entity_assemble,
    complete_entities, complete_named, dict_last_wins, last_present, relations_by_pair, degrees, row_cap, file_last_wins, nt_file_edges, subprop_file, subgraph, subgraph_items,
    subgraph_props, unused_entities, shared_ids, subprop_edges,
)}

_FREQ = """
WITH edge AS (SELECT pos, subj, rel, obj FROM triples WHERE subj IS NOT NULL AND rel IS NOT NULL AND obj IS NOT NULL),
freq AS (
  SELECT qid, CAST(sum(n) AS BIGINT) AS freq FROM (
    SELECT subj AS qid, CASE WHEN starts_with(subj, 'Q') THEN 1 ELSE 0 END AS n FROM edge
    UNION ALL SELECT obj, CASE WHEN starts_with(obj, 'Q') THEN 1 ELSE 0 END FROM edge
    UNION ALL SELECT rel, 1 FROM edge) GROUP BY qid
)
"""

# Java's \s is ASCII only; DuckDB's RE2 agrees
_SQ = "trim(regexp_replace({}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ')"

_LIT = (
    """
, lit AS (
  SELECT pos, qid, field, """
    + _SQ.format("v")
    + """ AS value FROM (
    SELECT row_id * 1000 AS pos, qid, 'name' AS field, name AS v FROM items
    UNION ALL SELECT row_id * 1000 + 1, qid, 'desc', "desc" FROM items
    UNION ALL SELECT row_id * 1000 + 3 + i, qid, 'aka', a FROM
      (SELECT row_id, qid, unnest(aka) AS a, unnest(range(len(aka))) AS i FROM items)
  ) WHERE qid IS NOT NULL AND v <> '' AND """
    + _SQ.format("v")
    + """ <> ''
), found AS (
  SELECT qid, coalesce(arg_max(value, pos) FILTER (field = 'name'), '') AS name,
    coalesce(arg_max(value, pos) FILTER (field = 'desc'), '') AS "desc",
    coalesce(array_to_string(list(value ORDER BY pos) FILTER (field = 'aka'), '|'), '') AS aka FROM lit GROUP BY qid
), ent AS (
  SELECT coalesce(f.qid, l.qid) AS qid, coalesce(name, '') AS name, coalesce("desc", '') AS "desc", coalesce(aka, '') AS aka,
    coalesce(freq, 0) AS freq FROM found l FULL JOIN freq f ON l.qid = f.qid
)
"""
)

_SUB = (
    _FREQ
    + """
, it AS (SELECT * FROM freq WHERE NOT starts_with(qid, 'P') ORDER BY freq DESC, qid LIMIT 1000),
pr AS (SELECT * FROM freq WHERE starts_with(qid, 'P') ORDER BY freq DESC, qid LIMIT 30),
kept AS (SELECT * FROM edge WHERE subj IN (SELECT qid FROM it) AND obj IN (SELECT qid FROM it) AND rel IN (SELECT qid FROM pr))
"""
)

ORACLE = {
    "items_by_freq": _FREQ + "SELECT row_number() OVER (ORDER BY freq DESC, qid) - 1 AS place, qid, freq FROM freq WHERE NOT starts_with(qid, 'P')",
    "file_last_wins": 'SELECT qid, row_id, name, "desc" FROM items WHERE qid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY qid ORDER BY row_id DESC) = 1',
    "nt_file_edges": """SELECT row_number() OVER (ORDER BY pos) - 1 AS place, subj, rel, obj FROM triples
WHERE regexp_matches(subj, '^[PQ][0-9]') AND regexp_matches(rel, '^[PQ][0-9]') AND regexp_matches(obj, '^[PQ][0-9]')""",
    "subprop_file": "SELECT s AS child, o AS parent FROM subprops WHERE starts_with(s, 'P') AND starts_with(o, 'P')",
    "nt_parse_edges": """SELECT pos, regexp_extract(subj, '^[PQ][0-9]+') AS subj, regexp_extract(rel, '^[PQ][0-9]+') AS rel,
  regexp_extract(obj, '^[PQ][0-9]+') AS obj FROM triples WHERE subj IS NOT NULL AND rel IS NOT NULL AND obj IS NOT NULL""",
    "nt_parse_values": _FREQ + _LIT + "SELECT pos, qid, field, value FROM lit",
    "nt_strict_language": _FREQ + _LIT + "SELECT pos, qid, field, value FROM lit WHERE field <> 'desc'",
    "desc_preprocess": "SELECT row_id, "
    + _SQ.format("""regexp_replace(regexp_replace(regexp_replace(regexp_replace("desc",
  '\\(.*\\)', '', 'g'), '\\[.*\\]', '', 'g'), '\\{.*\\}', '', 'g'), '[:;].+$', '')""")
    + " AS short FROM items",
    "triple_freq": _FREQ + "SELECT qid, freq FROM freq",
    "top_items": _FREQ + "SELECT qid, freq FROM freq WHERE NOT starts_with(qid, 'P') ORDER BY freq DESC, qid LIMIT 50",
    "top_props": _FREQ + "SELECT qid, freq FROM freq WHERE starts_with(qid, 'P') ORDER BY freq DESC, qid LIMIT 50",
    "entity_assemble": _FREQ + _LIT + 'SELECT qid, name, "desc", aka, freq FROM ent',
    "complete_entities": _FREQ + _LIT + """SELECT qid, name, "desc", aka, freq FROM ent WHERE name <> '' AND "desc" <> '' AND aka <> ''""",
    "complete_named": _FREQ + _LIT + "SELECT qid, name FROM ent WHERE name <> ''",
    "dict_last_wins": """SELECT qid, row_id, name, "desc", freq.triple AS triple FROM items
  WHERE qid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY qid ORDER BY row_id DESC) = 1""",
    "last_present": """SELECT qid, arg_max(name, row_id) AS name, arg_max("desc", row_id) AS "desc" FROM properties WHERE qid IS NOT NULL GROUP BY qid""",
    "relations_by_pair": _FREQ + "SELECT subj, obj, array_to_string(list(rel ORDER BY pos), ',') AS rels, arg_max(rel, pos) AS last_rel FROM edge GROUP BY subj, obj",
    "degrees": _FREQ + """SELECT qid, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(i) AS BIGINT) AS n_in FROM
  (SELECT subj AS qid, 1 AS o, 0 AS i FROM edge UNION ALL SELECT obj, 0, 1 FROM edge) GROUP BY qid""",
    "row_cap": "SELECT pos, subj, rel, obj FROM triples ORDER BY pos LIMIT 500",
    "subgraph": _SUB + "SELECT pos, subj, rel, obj FROM kept",
    "subgraph_items": _SUB + """, last AS (SELECT * FROM items QUALIFY row_number() OVER (PARTITION BY qid ORDER BY row_id DESC) = 1)
SELECT it.qid, concat_ws(chr(9), it.qid, coalesce(name, ''), CAST(it.freq AS VARCHAR), coalesce("desc", ''), coalesce(array_to_string(aka, ','), '')) AS line
FROM it LEFT JOIN last ON it.qid = last.qid WHERE it.qid IN (SELECT subj FROM kept UNION ALL SELECT obj FROM kept)""",
    "subgraph_props": _SUB + "SELECT qid, freq FROM pr WHERE qid IN (SELECT rel FROM kept)",
    "unused_entities": """SELECT DISTINCT qid FROM items WHERE qid NOT IN
  (SELECT subj FROM triples WHERE subj IS NOT NULL UNION ALL SELECT obj FROM triples WHERE obj IS NOT NULL)""",
    "shared_ids": "SELECT subj AS qid FROM triples INTERSECT SELECT obj FROM triples INTERSECT SELECT qid FROM items",
    "subprop_edges": "SELECT edge_id, s, o FROM subprops WHERE starts_with(s, 'P') AND starts_with(o, 'P')",
}
