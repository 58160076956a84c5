"""Wiki pages by option, each with the text that the markup's rules give it, written by hand.

A query deals the cases out to all documents and puts the document's title in for
``@T``; its SQL holds the expected texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kernmill.session import read_spread
from kernmill.wikitext import extract
from kernmill.wikitext.markup import Options

TEMPLATES = {
    "Template:Only": "a<onlyinclude>b</onlyinclude>c<onlyinclude>d</onlyinclude>",
    "Template:Incl": "x<includeonly>y</includeonly><noinclude>z</noinclude><!-- no -->",
    "Template:Par": "{{{1|one}}},{{{x|named}}},{{{1|}}}",
    "Template:Rest": "k<noinclude>never closed",
    "Template:Moved": "#REDIRECT [[Template:Par]]",
    "Template:Round1": "#REDIRECT [[Template:Round2]]",
    "Template:Round2": "#REDIRECT [[Template:Round1]]",
    "Template:Deep": "({{Par|{{{1}}}|x={{Incl}}}})",
    "Template:Len": "{{#invoke:String|len}}",
}

#: (source, text below the title) by option.
CASES: dict[str, list[tuple[str, str]]] = {
    "plain": [
        ("a <nowiki>{{Par}} [[x]]</nowiki> b", "a [[x|x]] b"),
        ("f <math>a+b</math> and <math>c</math>, <math>a+b</math>; <code>x</code>.", "f formula_1 and formula_2, formula_1; codice_1."),
        ("A<ref>note <ref name=\"x\">in</ref></ref> b<ref name=\"y\" /> c<br/>d <gallery>\nq\n</gallery>e", "A b cd e"),
        ("see [http://a.example http://b.example/c.png] and [http://a.example the ''site''] x", "see and the \"site\" x"),
        ("{{Only}} {{Incl}} {{Rest}}.", "bd xy k."),
        ("{{#iferror:{{#expr:1/0}}|bad|ok}} {{#iferror:1|bad|ok}} {{#iferror:2}}.", "bad ok 2."),
        ("{{#expr:(1+2)*3}} {{#expr:7 mod 4}} {{#expr:2^10}} {{#expr:10/4}} {{#expr:not 0}} {{#expr:3.14159 round 2}} {{#expr:1<2 and 3>=3}}.", "9 3 1024 2.5 1 3.14 1."),
        ("{{#invoke:String|sub|abcdef|2|-2}} {{#invoke:String|pos|abc|-1}} {{#invoke:String|find|abcabc|c|4}} {{#invoke:String|rep|ab|3}}.", "bcde c 6 ababab."),
        ("{{#invoke:String|replace|aXa|X|b}} {{#invoke:String|sublength|i=1|len=2|s=abcd}} {{Len|abcd}} {{#invoke:String|nope|x}}.", "aba bc 4 ."),
        ("{{#invoke:Roman|main|1999}} {{#invoke:Roman|main|5000|many}} {{#invoke:If empty|main||x|y}} {{#invoke:Convert|convert|5|km}}.", "MCMXCIX many x 5 km."),
        ("{{lc:ABc}} {{uc:abC}} {{lcfirst:ABC}} {{ucfirst:abc}} {{urlencode:a b/c}} {{int:07}}{{#time:Y}}{{#ifexpr:1|a|b}}.", "abc ABC aBC Abc a%20b/c 7."),
        ("{{#switch:b|a|b=1|c=2|#default=3}} {{#switch:q|a=1|7}} {{#ifeq:a|a|{{#if:x|yes|no}}|n}} {{#ifeq:a|b|t}} {{#ifexist:x|a|b}}.", "1 7 yes b."),
        ("{{CURRENTYEAR}}-{{CURRENTMONTH}} {{!}} {{subst:Par|s}} {{Par|x=1|x=2|p}} {{Deep|w}}.", "2024-01 | s,named,s p,2,p (w,xy,w)."),
        ("{{Moved|m}} {{Round1}} {{None|x}} {{{q|default}}} {{:Only}}.", "m,named,m default ."),
        ("[[a]]s [[b|c]]d [[File:x.png|thumb|[[q]] r]] [[w:z|y]] [[ k | l ]].", "[[a|as]] [[b|cd]] [[w:z|y]] [[k|l]]."),
        ("one\n{|\n| cell\n|-\n{|\n| inner\n|}\n|}\ntwo", "one\n\ntwo"),
        ("R&amp;D &#65;&#x42; &nope; <<x>>,, y,. ......\n---\nlast\tline", "R&D AB &nope; «x», y. ...\nlast line"),
        ("'''@T''' is '''b''' ''i'' '''''both''''' ''\"q\"'' <b>t</b> __NOTOC__", "[[@T|@T]] is b \"i\" both \"q\" t "),
        ("intro\n\n== E ==\n== S ==\n* one\n# two\nafter\n:ind\n(par)\n|cell\n lead\nend", "intro\n\nafter\nend"),
        ("<!-- gone\n -->x<syntaxhighlight lang=\"p\">y = 1</syntaxhighlight> z<s>w</s>", "xy = 1 zw"),
    ],
    "lists": [
        ("== S ==\n* one\n# two\n# three\n** deep\n\n=== Empty ===\n== Q? ==\nend [[a|b]]", "S.\n- one\n1. two\n2. three\n- deep\n\nQ?\nend b"),
        ("; term\n: text\n== A ==\n=== B ===\nline", "- term\nA.\nB.\nline"),
        ("== A ==\n=== B ===\n=== C ===\n lead\n next\nplain", "A.\nC.\n lead\nplain"),
    ],
    "html": [
        ("== A ==\n* one\n** two\n# three\ntext\n=== Empty ===\n== B? ==\n; t\nend",
         "<h2>A</h2>\n<ul>\n<li>one</li>\n<ul>\n<li>two</li>\n</ul>\n</ul>\n<ol>\n<li>three</li>\n</ol>\ntext\n<h2>B?</h2>\n<dl>\n<dt>t</dt>\n</dl>\nend"),
        ("a &amp; b '''c''' [http://a.example d]", "a &amp;amp; b c &lt;a href=\"http://a.example\"&gt;d&lt;/a&gt;"),
    ],
    "tables": [("one\n{|\n! style=\"x\" head\n|-\nrow\n|}\ntwo", "one\nrow\ntwo")],
    "unexpanded": [("a {{Par|{{Incl}}}} b {{#if:x|y}} c", "a b c")],
}

OPTIONS = {
    "plain": Options(),
    "lists": Options(keep_links=False, keep_sections=True, keep_lists=True),
    "html": Options(keep_links=False, keep_sections=True, keep_lists=True, to_html=True),
    "tables": Options(keep_links=False, keep_tables=True),
    "unexpanded": Options(expand_templates=False),
}


def run(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """``id, text``: each document gets one of the cases of an option."""
    rows = [(k, 10, v) for k, v in TEMPLATES.items()]
    store = extract.store_templates(spark.createDataFrame(rows, "title string, ns int, text string"))
    cases = CASES[name]
    title = F.coalesce("title", F.lit("Untitled"))
    source = F.replace(F.element_at(F.array(*[F.lit(s) for s, _ in cases]), (F.pmod("doc_id", F.lit(len(cases))) + 1).cast("int")), F.lit("@T"), title)
    pages = read_spread(spark, f"{sf}/documents.parquet").select(
        F.col("doc_id").alias("id"), F.lit(None).alias("revid"), title.alias("title"), F.lit(0).alias("ns"), source.alias("text")
    )
    return extract.extract_pages(pages, OPTIONS[name], "", store).select("id", "text")


QUERIES = {f"wikitext_{n}": (lambda spark, sf, n=n: run(spark, sf, n)) for n in CASES}


def _sql(name: str) -> str:
    cases = CASES[name]
    quoted = ", ".join("(" + str(i) + ", '" + want.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "')" for i, (_, want) in enumerate(cases))
    return f"""WITH c(k, want) AS (VALUES {quoted}), d AS (SELECT doc_id, coalesce(title, 'Untitled') AS t FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS id, t || chr(10) || chr(10) || replace(want, '@T', t) AS text FROM d JOIN c ON ((doc_id % {len(cases)}) + {len(cases)}) % {len(cases)} = k"""


ORACLE = {f"wikitext_{n}": _sql(n) for n in CASES}
