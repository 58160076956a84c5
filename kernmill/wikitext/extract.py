"""Pages to extracted articles, distributed: one narrow Arrow pass over the pages.

Templates are written once to the shared folder, cut into shards by title; a
worker reads a shard when a page first needs it and keeps a bounded number of
them.  Nothing is broadcast, so the number of templates does not matter.
"""

from __future__ import annotations

import zlib
from collections import OrderedDict
from datetime import datetime

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kernmill.operators.corpus import DISAMBIGUATION
from kernmill.session import new_path
from kernmill.wikitext import markup
from kernmill.wikitext.markup import Options
from kernmill.wikitext.templates import Expander, Namespaces, title_case

SHARDS = 256
KEPT_SHARDS = 64


def shard_of(title: str) -> int:
    return zlib.crc32(title.encode()) % SHARDS


def _shard() -> Column:
    """``shard_of(title_case(title))`` in the JVM."""
    t = F.trim(F.regexp_replace(F.col("title"), r"(?U)[\s_]+", " "))
    cased = F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, F.lit(2), F.length(t)))
    return F.pmod(F.crc32(F.encode(cased, "UTF-8")), F.lit(SHARDS)).cast("int")


def store_templates(pages: DataFrame, namespaces: tuple[int, ...] = (10, 828)) -> str:
    """Write the template pages (``title, ns, text``) as shards; returns their address.

    Of pages with the same title the one with the largest text in byte order stays.
    ``release_staged`` deletes the shards with the staged tables.
    """
    t = pages.where(F.col("ns").isin(*namespaces) & F.col("title").isNotNull()).select("title", "text")
    one = t.groupBy("title").agg(F.max(F.coalesce("text", F.lit(""))).alias("text")).withColumn("shard", _shard())
    path = new_path(pages.sparkSession, "templates")
    one.repartition("shard").write.partitionBy("shard").parquet(path)
    return path


class TemplateStore:
    """Lookup of template sources by full title; a bounded number of shards is kept."""

    def __init__(self, path: str | None):
        self.path, self.shards = path, OrderedDict()

    def __call__(self, title: str) -> str | None:
        if self.path is None:
            return None
        k = shard_of(title)
        if k not in self.shards:
            self.shards[k] = self._load(k)
            if len(self.shards) > KEPT_SHARDS:
                self.shards.popitem(last=False)
        self.shards.move_to_end(k)
        return self.shards[k].get(title)

    def _load(self, k: int) -> dict[str, str]:
        files, root = fs.FileSystem.from_uri(self.path)
        if files.get_file_info(root).type == fs.FileType.NotFound:
            raise FileNotFoundError(f"no template shards at {self.path}")
        where = f"{root}/shard={k}"
        if files.get_file_info(where).type == fs.FileType.NotFound:
            return {}
        t = ds.dataset(where, filesystem=files, format="parquet").to_table(columns=["title", "text"])
        return {title_case(a): b for a, b in zip(*(t.column(c).to_pylist() for c in ("title", "text")))}


def magic_words(title: str, opt: Options, spaces: Namespaces) -> dict[str, str]:
    """Values of the magic words for a page; the clock is ``opt.as_of``, so results can be repeated."""
    key, page = spaces.split(title)
    space = spaces.local[key] if key else ""
    at = datetime.fromisoformat(opt.as_of)
    cut = page.rfind("/")
    return {
        "NAMESPACE": space, "NAMESPACENUMBER": str(key), "PAGENAME": page, "FULLPAGENAME": title,
        "BASEPAGENAME": page[:cut] if cut >= 0 else page, "SUBPAGENAME": page[cut + 1 :] if cut >= 0 else "",
        "ROOTPAGENAME": page.partition("/")[0], "CURRENTYEAR": at.strftime("%Y"), "CURRENTMONTH": at.strftime("%m"),
        "CURRENTDAY": at.strftime("%d"), "CURRENTHOUR": at.strftime("%H"), "CURRENTTIME": at.strftime("%H:%M:%S"), **opt.magic,
    }


def extract_one(title: str, source: str | None, lookup, opt: Options, spaces: Namespaces | None = None) -> str | None:
    """Text of one page: title line, blank line, paragraphs; None if it is too short."""
    text, spaces = source or "", spaces or Namespaces()
    pieces = text.split("<nowiki>")
    done = []
    for i, p in enumerate(pieces):
        raw, end, rest = ("", "", p) if i == 0 else p.partition("</nowiki>")
        if i and not end:
            raw, rest = "", "<nowiki>" + raw
        if opt.expand_templates:
            rest = Expander(lookup, magic_words(title, opt, spaces), spaces).expand(rest)
        else:
            rest = markup.drop_balanced(rest, r"\{\{", r"\}\}")
        done.append(raw + rest)
    lines = markup.compact(markup.clean(markup.to_text("".join(done), title, opt), opt), opt)
    lines = [title, "", *lines]
    if sum(map(len, lines)) < opt.min_length:
        return None
    return "\n".join(lines)


def extract_pages(
    pages: DataFrame, opt: Options | None = None, base_url: str = "", templates: str | None = None, namespaces: dict[str, int] | None = None
) -> DataFrame:
    """``id, url, title, text[, revid]`` of content pages (``id, revid, title, ns, text``).

    Main namespace only, disambiguation pages left out if asked for; both filters run
    before Python.  ``templates`` is an address from ``store_templates``, ``namespaces``
    the names of the dump's siteinfo.  Null titles give no page; a null text is an
    empty page.  A page that repeats the id of the page read before it is left out, as
    dumps may state a page twice in a row; a null id never is a repeat.
    """
    opt = opt or Options()
    keep = (F.col("ns") == 0) & F.col("title").isNotNull()
    if opt.skip_disambiguation:
        keep = keep & ~F.coalesce("text", F.lit("")).rlike(DISAMBIGUATION)
    narrow = pages.where(keep).select(F.col("id").cast("string"), F.col("revid").cast("string"), "title", "text")

    def run(batches):
        store, spaces, before = TemplateStore(templates), Namespaces(namespaces), None
        for b in batches:
            rows = []
            for i, r, t, x in zip(*(b.column(k).to_pylist() for k in range(4))):
                if i is not None and i == before:
                    continue
                before = i
                made = extract_one(t, x, store, opt, spaces)
                if made is not None:
                    rows.append((i, f"{base_url}?curid={i}", t, made, r))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["id", "url", "title", "text", "revid"])

    out = narrow.mapInArrow(run, "id string, url string, title string, text string, revid string")
    return out if opt.with_revision else out.drop("revid")


def single_article(pages: DataFrame, article: int | str, opt: Options | None = None, **rest) -> DataFrame:
    """The extracted page of one id or title."""
    one = F.col("id") == article if isinstance(article, int) else F.col("title") == article
    return extract_pages(pages.where(one), opt, **rest)


def as_document(pages: DataFrame, as_json: bool = True) -> DataFrame:
    """One column ``value``: each page as a JSON line or as a ``<doc>`` element."""
    if as_json:
        return pages.select(F.to_json(F.struct(*pages.columns)).alias("value"))
    named = ["id", *(["revid"] if "revid" in pages.columns else []), "url", "title"]
    parts = [x for c in named for x in (F.lit(f' {c}="'), F.col(c), F.lit('"'))]
    head = F.concat_ws("", F.lit("<doc"), *parts, F.lit(">\n"))
    return pages.select(F.concat(head, "text", F.lit("\n</doc>\n")).alias("value"))


