import pytest

from kernmill.wikitext import functions as fn
from kernmill.wikitext import markup as M
from kernmill.wikitext.extract import extract_one
from kernmill.wikitext.templates import Argument, Expander, Template, parse, transcluded

STORE = {
    "Template:A": "<{{{1|none}}}>", "Template:Named": "{{{x}}}-{{{y|d}}}", "Template:Loop": "l{{Loop}}", "Template:R": "#REDIRECT [[Template:A]]",
    "Template:Nest": "{{A|{{{1}}}}}", "Template:Inv": "{{#invoke:String|len}}", "Main page": "main",
}


def _x(text, magic=None):
    return Expander(STORE.get, magic or {}).expand(text)


@pytest.mark.parametrize("text,want", [
    ("{{A}}", "<none>"), ("{{A|b}}", "<b>"), ("{{A|1=x|1=y}}", "<y>"), ("{{A| b }}", "<b>"), ("{{Nest|{{A|c}}}}", "<<c>>"),
    ("{{named|x=1}}", "1-d"), ("{{R|z}}", "<z>"), ("{{None}}", ""), ("{{subst:A|q}}", "<q>"), ("{{:Main page}}", "main"),
    ("{{{1|a}}}", "a"), ("{{A|[[b|c]]}}", "<[[b|c]]>"), ("{{#if: |y|n}}", "n"), ("{{#if:x|{{A|1}}|n}}", "<1>"), ("{{#ifeq:a|a|t|f}}", "t"),
    ("{{#ifeq:a|b|t}}", ""), ("{{#switch:b|a|b=1|#default=2}}", "1"), ("{{#switch:q|a=1|7}}", "7"), ("{{#switch:q|#default=2|a=1}}", "2"),
    ("{{#iferror:{{#expr:1/0}}|bad|ok}}", "bad"), ("{{#iferror:x|bad|ok}}", "ok"), ("{{#ifexist:x|a|b}}", "b"), ("{{#time:Y}}", ""),
    ("{{uc:ab}}", "AB"), ("{{lcfirst:AB}}", "aB"), ("{{urlencode:a b/c}}", "a%20b/c"), ("{{int:07}}", "7"), ("{{int:x}}", ""),
    ("{{#invoke:String|len|abc}}", "3"), ("{{Inv|abcd}}", "4"), ("{{#invoke:Nope|x}}", ""), ("a {{ b", "a {{ b"), ("a }} b", "a }} b"),
    ("{{!}}", "|"), ("{{{{A}}}}", "{{{{A}}}}"), ("{ {{A}} }", "{ <none> }"),
])
def test_expansion(text, want):
    assert _x(text) == want


def test_limits_and_magic():
    assert 1 <= _x("{{Loop}}").count("l") <= 40
    assert _x("{{PAGENAME}}/{{x|PAGENAME}}", {"PAGENAME": "T"}) == "T/"
    assert _x("{{" * 500 + "}}" * 500) is not None


def test_brace_rules():
    assert parse("{{{a}}}") == (Argument((("a",),)),)
    assert parse("{{a|b}}") == (Template((("a",), ("b",))),)
    t = parse("{{{{{1}}}|x}}")[0]
    assert isinstance(t, Template) and isinstance(t.parts[0][0], Argument)
    assert transcluded("a<noinclude>b</noinclude><includeonly>c</includeonly><!-- d -->") == "ac"
    assert transcluded("a<onlyinclude>b</onlyinclude>c<onlyinclude>d</onlyinclude><noinclude>e") == "bd"


@pytest.mark.parametrize("text,want", [
    ("1+2*3", "7"), ("(1+2)*3", "9"), ("-2^2", "4"), ("7 mod 4", "3"), ("10 div 4", "2.5"), ("2 round 0", "2"), ("3.14159 round 2", "3.14"),
    ("not 0 and 1", "1"), ("1 < 2 or 0", "1"), ("", ""), ("abs(-3)", "3"), ("1e3", "1000"),
])
def test_expr(text, want):
    assert fn.expr(text) == want


@pytest.mark.parametrize("text", ["1/0", "__import__('os')", "2**", "a", "1 2", "(" * 50, "9^9^9^9", "ln 0"])
def test_expr_errors(text):
    assert fn.ERROR in fn.expr(text)


def test_modules():
    assert [fn.roman(n) for n in (0, 4, 9, 14, 1999, 4999)] == ["", "IV", "IX", "XIV", "MCMXCIX", "MMMMCMXCIX"]
    assert fn.invoke("Roman", "main", {"1": "5000", "2": "big"}) == "big"
    s = lambda f, **p: fn.invoke("String", f, {k.strip("_"): v for k, v in p.items()})
    assert s("sub", s="abcdef", i="2", j="-2") == "bcde"
    assert s("find", source="abcabc", target="c", start="4") == "6"
    assert s("rep", source="ab", count="3") == "ababab"
    assert s("replace", source="aXa", pattern="X", replace="b") == "aba"
    assert s("pos", target="abc", pos="-1") == "c"


O = M.Options()


def test_links():
    assert M.internal_links("[[a]]s [[b|c]]d [[File:x.png|thumb|[[q]] r]] [[w:z|y]] [[:File:q]]", O) == "[[a|as]] [[b|cd]]  [[w:z|y]] "
    assert M.external_links("[http://a.b c d] [http://a.b] x [[l]]", O) == "c d  x [[l]]"
    assert M.to_text("'''T''' is '''b''' ''i'' __NOTOC__{{x|{{y}}}}{|\n|c\n|}", "T t", O).strip() == '[[T t|T]] is b "i"'


def test_clean():
    text = "a<!-- c --> b<br/> <i>c</i><ref>x<ref>y</ref></ref> <math>q</math> <math>r</math> <math>q</math> &amp;nbsp; ....... <<z>>"
    assert M.clean(text, O) == "a b c formula_1 formula_2 formula_1 &nbsp; ... «z»"
    assert M.drop_balanced("a{{b{{c}}d", r"\{\{", r"\}\}") == "a{{b{{c}}d"


def test_compact():
    text = "intro\n\n== E ==\n== S ==\n* one\n# two\nafter list\nbody\n:ind\n(par)\n|cell\n lead\n"
    assert M.compact(text, O)[:4] == ["intro", "", "after list", "body"]
    kept = M.compact("== S ==\n* one\n# two\n# three\n\nx", M.Options(keep_sections=True, keep_lists=True))
    assert kept[:4] == ["S.", "- one", "1. two", "2. three"]


def test_page():
    assert extract_one("T", "'''T''' is {{A|x}}.\n\n== E ==\n", STORE.get, O) == "T\n\n[[T|T]] is <x>.\n"
    assert extract_one("T", None, STORE.get, O) == "T\n"
    assert extract_one("T", "x", STORE.get, M.Options(min_length=100)) is None
