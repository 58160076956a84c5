"""Deeply nested JSON records into flat, linked tables (problem 1).

Every node of a record gets a Dewey label: the ordinals on the way from the root
to it.  Cutting the last ordinal off gives the parent's label, so no ids have to
be handed out and no shuffle is needed.  Nodes are grouped into tables by schema
path, the path of keys in which array places read '[]' and keys of map-like
objects read '*'.  A table's columns name the relative paths, in order of
preference, at which dirty producers put the value.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTITY_FIELDS = ("qid", "pid", "title", "name", "aka", "desc", "text", "link", "contexts", "triples")
MAP_FIELDS = frozenset({("link",)})
_INT = re.compile(r"\s*[+-]?[0-9]{1,18}\s*\Z")


@dataclass
class Node:
    dewey: tuple
    steps: tuple
    schema: tuple
    kind: str  # object, array, string, number, boolean, null
    value: object


def _kind(v) -> str:
    if isinstance(v, dict):
        return "object"
    if isinstance(v, list):
        return "array"
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    return "string" if isinstance(v, str) else "number"


def label_nodes(record, map_fields: frozenset = MAP_FIELDS) -> list[Node]:
    """Nodes of a parsed record in document order; the root is labelled ()."""
    out, todo = [], [((), (), (), record)]
    while todo:
        dewey, steps, schema, v = todo.pop()
        kind = _kind(v)
        out.append(Node(dewey, steps, schema, kind, v))
        if kind == "object":
            wild = schema in map_fields
            kids = [((*dewey, i), (*steps, k), (*schema, "*" if wild else k), x) for i, (k, x) in enumerate(v.items())]
        elif kind == "array":
            kids = [((*dewey, i), (*steps, i), (*schema, "[]"), x) for i, x in enumerate(v)]
        else:
            continue
        todo.extend(reversed(kids))
    return out


def find_entity(v):
    """The outermost object with a qid or two other entity fields, else None.

    Wrappers are searched level by level, so the record nearest to the root wins.
    """
    level = [v]
    while level:
        for x in level:
            if isinstance(x, dict) and ("qid" in x or sum(f in x for f in ENTITY_FIELDS) >= 2):
                return x
        level = [y for x in level for y in (x.values() if isinstance(x, dict) else x) if isinstance(y, (dict, list))]
    return None


def read_record(line: str | None):
    """The entity object of a line, or None for a blank, broken or non-object line."""
    if line is None or not line.strip():
        return None
    try:
        v = json.loads(line)
    except (ValueError, RecursionError):
        return None
    if not isinstance(v, dict):
        return None
    return find_entity(v) or v


def as_int(v) -> int | None:
    """Integers and integers written as strings; anything else is absent."""
    if isinstance(v, bool):
        return None
    if isinstance(v, int):
        return v if -(2**62) < v < 2**62 else None
    if isinstance(v, str) and _INT.match(v):
        return int(v)
    return None


def as_text(v) -> str | None:
    """Text of a scalar; lone surrogates, which no table can hold, become U+FFFD."""
    if v is None or isinstance(v, (dict, list)):
        return None
    if isinstance(v, str):
        try:
            v.encode()
        except UnicodeEncodeError:
            v = v.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
        return v
    return json.dumps(v)


@dataclass(frozen=True)
class Table:
    """A child table: the schema paths of its entries and where its columns lie.

    A column maps to relative paths; the first that leads to a non-null scalar
    wins.  The empty path is the entry itself, '@' the entry's own key or place.
    """

    name: str
    entries: tuple
    columns: dict = field(hash=False)


SPAN_BEGIN = (("span", "begin"), ("span", 0))
SPAN_END = (("span", "end"), ("span", 1))
#: Shapes in which producers write link entries and contexts entries.
LINKS = Table(
    "links",
    (("link", "*"), ("link", "[]")),
    {
        "target": (("target",), ("@",)),
        "para_no": (("para",), ("at", "para"), (0,)),
        "sent_no": (("sent",), ("at", "sent"), (1,)),
        "tok_begin": (*SPAN_BEGIN, (2, 0), (2, "begin"), (2,)),
        "tok_end": (*SPAN_END, (2, 1), (2, "end"), (3,)),
    },
)
CONTEXTS = Table(
    "contexts",
    (("contexts", "[]"),),
    {
        "ctx_no": (("@",),),
        "sentence": (("sentence",), (0,)),
        "tok_begin": (*SPAN_BEGIN, (1, 0), (1, "begin"), (1,)),
        "tok_end": (*SPAN_END, (1, 1), (1, "end"), (2,)),
    },
)
ALIASES = Table("aliases", (("aka", "[]"),), {"alias_no": (("@",),), "alias": ((),)})
TRIPLES = Table(
    "triples",
    (("triples", "[]"),),
    {"triple_no": (("@",),), "subj": (("subj",), (0,)), "rel": (("rel",), (1,)), "obj": (("obj",), (2,))},
)
PARAGRAPH = ("text", "[]")
#: Schema paths, relative to a paragraph, at which a sentence may stand.
SENTENCE_PATHS = frozenset({(), ("[]",), ("sents", "[]"), ("sents",)})
SENTENCE_KEYS = ("s", "sentence", "text")


def table_rows(nodes: list[Node], table: Table) -> Iterator[tuple[tuple, dict]]:
    """(Dewey label of the entry, columns) of each entry, in document order.

    Nodes below an entry share its label as prefix and follow it directly.
    """
    paths = set(table.entries)
    depth = len(table.entries[0])
    i, n = 0, len(nodes)
    while i < n:
        e = nodes[i]
        i += 1
        if e.schema not in paths:
            continue
        below = {(): e}
        while i < n and nodes[i].dewey[:depth] == e.dewey:
            below[nodes[i].steps[depth:]] = nodes[i]
            i += 1
        row = {}
        for col, places in table.columns.items():
            row[col] = None
            for p in places:
                if p == ("@",):
                    row[col] = e.steps[-1]
                elif p in below and below[p].kind in ("string", "number", "boolean"):
                    row[col] = below[p].value
                if row[col] is not None:
                    break
        yield e.dewey, row


def sentence_rows(nodes: list[Node]) -> Iterator[tuple[tuple, int, int, str | None]]:
    """(label, paragraph, sentence, text) of each sentence; both places from zero.

    A paragraph may be an array, an object with ``sents`` or a bare string; null and
    empty ones keep their place.  A null sentence keeps its place and has no text.
    """
    for nd in nodes:
        if nd.schema[:2] != PARAGRAPH or nd.schema[2:] not in SENTENCE_PATHS:
            continue
        rel = nd.schema[2:]
        place = nd.steps[-1] if rel[-1:] == ("[]",) else 0
        if nd.kind == "string":
            yield nd.dewey, nd.steps[1], place, nd.value
        elif rel[-1:] == ("[]",):
            text = None
            if nd.kind == "object":
                text = next((nd.value[k] for k in SENTENCE_KEYS if isinstance(nd.value.get(k), str)), None)
            yield nd.dewey, nd.steps[1], place, text


def _label(d: tuple) -> str:
    return ".".join(map(str, d))


SCHEMAS = {
    "nodes": "dewey string, parent string, path string, key string, kind string, value string",
    "entities": "dewey string, qid string, pid string, title string, name string, aka array<string>, `desc` string",
    "sentences": "dewey string, parent string, para_no bigint, sent_no bigint, sentence string, n_tokens bigint",
    "aliases": "dewey string, parent string, alias_no bigint, alias string",
    "triples": "dewey string, parent string, triple_no bigint, subj string, rel string, obj string",
    "links": "dewey string, parent string, target string, para_no bigint, sent_no bigint, tok_begin bigint, tok_end bigint, usable boolean",
    "contexts": "dewey string, parent string, ctx_no bigint, sentence string, n_tokens bigint, tok_begin bigint, tok_end bigint, usable boolean",
}


def _inside(b, e, n) -> bool:
    return b is not None and e is not None and n is not None and 0 <= b <= e < n


def shred_line(record, tables: tuple[str, ...]) -> dict[str, list[tuple]]:
    """Rows of the named tables from one parsed record."""
    nodes = label_nodes(record)
    out: dict[str, list[tuple]] = {t: [] for t in tables}
    if "nodes" in out:
        out["nodes"] = [
            (_label(d.dewey), _label(d.dewey[:-1]) if d.dewey else None, ".".join(d.schema),
             as_text(str(d.steps[-1])) if d.steps else None, d.kind, as_text(d.value))
            for d in nodes
        ]
    if "entities" in out:
        top = {d.steps[0]: d for d in nodes if len(d.steps) == 1}
        text = lambda k: as_text(top[k].value) if k in top else None
        aka = [as_text(x) for x in top["aka"].value] if "aka" in top and top["aka"].kind == "array" else None
        out["entities"] = [("", text("qid"), text("pid"), text("title"), text("name"), aka, text("desc"))]
    for t in (ALIASES, TRIPLES):
        if t.name in out:
            out[t.name] = [
                (_label(d), _label(d[:-1]), *(v if c.endswith("_no") else as_text(v) for c, v in r.items())) for d, r in table_rows(nodes, t)
            ]
    lengths = {}
    if "sentences" in out or "links" in out:
        for d, p, s, t in sentence_rows(nodes):
            n = None if t is None else len(t.split())
            lengths[p, s] = n
            if "sentences" in out:
                out["sentences"].append((_label(d), _label(d[:-1]), p, s, as_text(t), n))
    if "links" in out:
        for d, r in table_rows(nodes, LINKS):
            p, s, b, e = (as_int(r[c]) for c in ("para_no", "sent_no", "tok_begin", "tok_end"))
            target = as_text(r["target"]) if isinstance(r["target"], str) else None
            ok = target is not None and _inside(b, e, lengths.get((p, s)))
            out["links"].append((_label(d), _label(d[:-1]), target, p, s, b, e, ok))
    if "contexts" in out:
        for d, r in table_rows(nodes, CONTEXTS):
            t = r["sentence"] if isinstance(r["sentence"], str) else None
            b, e = as_int(r["tok_begin"]), as_int(r["tok_end"])
            n = None if t is None else len(t.split())
            out["contexts"].append((_label(d), _label(d[:-1]), r["ctx_no"], as_text(t), n, b, e, _inside(b, e, n)))
    return out


def shred_union(raw: DataFrame, tables: tuple[str, ...], id_col: str = "line_no", json_col: str = "line") -> DataFrame:
    """Several flat tables of a column of JSON lines at once: ``table, line_no`` and all their columns.

    ``tables`` are names of ``SCHEMAS``; columns a table does not have are null in its
    rows.  Each line is parsed and labelled once, in one narrow pass without a shuffle.
    Null, blank, broken and non-object lines give no rows; repeated lines give their
    rows each; of a repeated key the last value counts.  Only the two columns named
    are read.
    """
    own = {t: T._parse_datatype_string(SCHEMAS[t]).fields for t in tables}
    fields = list({f.name: f for fs in own.values() for f in fs}.values())
    out_schema = T.StructType([T.StructField("table", T.StringType()), T.StructField("line_no", T.LongType()), *fields])
    arrow = pa.schema([("table", pa.string()), ("line_no", pa.int64()), *[(f.name, _arrow(f.dataType)) for f in fields]])
    place = {f.name: i for i, f in enumerate(fields)}
    # of each table, where its columns stand among all
    places = {t: [place[f.name] for f in fs] for t, fs in own.items()}

    def made(names, numbers, rows):
        columns = [names, numbers, *([r[i] for r in rows] for i in range(len(fields)))]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def run(batches):
        names, numbers, rows = [], [], []
        for batch in batches:
            for no, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                record = read_record(line)
                if record is None:
                    continue
                for t, found in shred_line(record, tables).items():
                    for r in found:
                        row = [None] * len(fields)
                        for i, v in zip(places[t], r):
                            row[i] = v
                        names.append(t)
                        numbers.append(no)
                        rows.append(row)
                if len(rows) >= 20_000:
                    yield made(names, numbers, rows)
                    names, numbers, rows = [], [], []
        if rows:
            yield made(names, numbers, rows)

    return raw.select(F.col(id_col).cast("long"), F.col(json_col).cast("string")).mapInArrow(run, out_schema)


def one_table(union: DataFrame, table: str) -> DataFrame:
    """The rows and columns of one table of ``shred_union``, with ``line_no``."""
    return union.where(F.col("table") == table).select("line_no", *T._parse_datatype_string(SCHEMAS[table]).fieldNames())


def shred(raw: DataFrame, table: str, id_col: str = "line_no", json_col: str = "line") -> DataFrame:
    """One flat table of a column of JSON lines; each row keeps ``line_no`` and its label (see ``shred_union``)."""
    return one_table(shred_union(raw, (table,), id_col, json_col), table)


def _arrow(t: T.DataType) -> pa.DataType:
    if isinstance(t, T.ArrayType):
        return pa.list_(pa.string())
    return {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}[t.simpleString()]


def usable_entries(raw: DataFrame) -> DataFrame:
    """Usable link and contexts entries of all lines in one table, from one pass.

    Columns ``line_no, field, child_key, para_no, sent_no, tok_begin, tok_end``; for
    contexts the key is the place in the array and para_no and sent_no are -1.
    """
    link = F.col("table") == "links"
    none = F.lit(-1).cast("long")
    return shred_union(raw, ("links", "contexts")).where("usable").select(
        "line_no",
        F.when(link, "link").otherwise("contexts").alias("field"),
        F.when(link, F.col("target")).otherwise(F.col("ctx_no").cast("string")).alias("child_key"),
        F.when(link, F.col("para_no")).otherwise(none).alias("para_no"),
        F.when(link, F.col("sent_no")).otherwise(none).alias("sent_no"),
        "tok_begin",
        "tok_end",
    )
