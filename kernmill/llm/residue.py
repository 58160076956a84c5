"""Template residue, filler text, error pages and script notices (problem 3).

Every description and sentence is a segment, and evidence is weighed for each of
them.  The segment's terms are compared with those of its slug (the record's title)
and of its body (the record's other segments); its shape, the slug's terms left out,
is counted over all titles and hosts (the record's source).  A segment that
recurs under several titles and hosts, shares no term with its own title or body and
whose words hardly occur outside it says nothing about any of them: it is a
duplicated response, whatever its language.  Detectors for placeholders, filler,
error responses, notices and words addressed to a reader are further evidence; what
they say weighs less where the segment speaks of its own title.  All of it is JVM
expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kernmill.operators.skew import hot_counts, salted_lookup
from kernmill.session import stage

#: Words of the usual made-up Latin.
FILLER_LATIN = (
    "lorem ipsum dolor sit amet consectetur consectetuer adipiscing adipisicing elit sed do eiusmod tempor incididunt "
    "ut labore et dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea "
    "commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur"
).split()

#: Reason phrases of web responses.
REASONS = (
    "bad request|unauthori[sz]ed|forbidden|(?:page |file |document )?not found|method not allowed|request time-?out|"
    "gone|conflict|too many requests|internal (?:server )?error|not implemented|bad gateway|service (?:temporarily )?unavailable|"
    "gateway time-?out|unknown error"
)

#: Unfilled placeholders, case matters.
PLACEHOLDERS = (
    r"\{\{.*|\{%.*?%\}|\$\{[^}]*\}|#\{[^}]*\}|<%.*?%>|<\?.*?\?>",
    r"\{\s?[A-Za-z_][\w .|-]*\}",
    r"%\([A-Za-z_]+\)[sdf]|%[A-Z][A-Z_]+%|\$[A-Z][A-Z_]+\$|@@\w+@@|__[A-Z][A-Z0-9_]+__|(?<![\w%])%[sdfY](?!\w)",
    r"<<[A-Z_ ]+>>|<[A-Z][A-Z_ ]+>|\[\[[A-Z][A-Z_ ]+\]\]|\[[A-Z][A-Z_ ]{2,}\]|(?i:\[\s?(?:insert|add|enter|your|description|title|name|placeholder)\b[^\]]*\])",
    r"(?i:<\s?(?:insert|add|enter|your)\b[^>]*>|\(\s?your [\w ]+ here\s?\))",
    r"#(?:VALUE!|REF!|NAME\?|N/A|DIV/0!|NULL!)|\[object \w+\]|@LINK\b|\bNaN\b",
    r"\b(?:TODO|FIXME|TBD|TBA)\b(?!\s+(?:is|are|was|were|has|had|stands)\b)|\bX{3,}\b|(?i:\bx{4,}\b)",
    r"(?i:\b(undefined|null|none|nil)\b(?: (?:in|of|from|by|and|near|is an?))? \1\b)",
)

#: Filler phrases, case does not matter.
FILLERS = (
    r"\byour (?:\w+ )?(?:text|content|description|title|name) (?:goes )?here\b|\b(?:text|description|content|title) goes here\b",
    r"\b(?:add|insert|enter|write|put) (?:your|an?|some|the) [^.]{0,40}\bhere\b",
    r"^\W*(?:sample|dummy|example|filler|placeholder) (?:text|content|description)\W*$|^\W*placeholder\W*$|^\W*untitled(?: \w+)?\W*$",
    r"\b(?:is|as) a placeholder\b|\bto be (?:added|written|filled in|done|announced)\W*$|\bwill be (?:added|filled in|written)\b[^.]{0,20}(?:later|soon)",
    r"^\W*(?:add|write|insert) (?:an?|your|some) [^.]*(?:text|content|paragraph|description)\b",
    r"\b(?:описание|текст) будет|\bhier (?:steht|folgt|kommt|entsteht)\b[^.]*\btext\b|\b(?:hier )?einfügen\W*$|\btexte à venir\b|\bà (?:compléter|ajouter)\W*$|\b(?:texto|descripción) (?:aquí|pendiente)\b",
)

#: Error responses.
ERRORS = (
    r"^\W*(?:(?:the|a|an|http|https|error|status|code|response|server|replied|said|sent|returned|fehler|erreur)\b\W*)*[1-9]\d{2}\s*[-–—|:(]*\s*(?:" + REASONS + r")\W*(?:$|[|(:;,.–—-]|\b(?:after|try|please|nginx|apache|for|at|on)\b)",
    r"^\W*(?:http|error|status|code|fehler|erreur|server (?:replied|said|returned|error))\W*(?:code|status|error)?\W*\d{3,5}\b",
    r"^\W*(?:" + REASONS + r")\W*(?:after\b.*|\(.*)?$",
    r"^\W*(?:page|seite|página|article|file) (?:not found|nicht gefunden|no encontrada)|\bpage (?:demandée )?est introuvable|страница не (?:найдена|существует)",
    r"\bpage (?:that )?(?:you|we) (?:asked for|requested|were looking for|tried)\b|\bcould not be found\W*$(?<!shows.{0,80})|\bpage (?:has been|was) (?:moved|removed|deleted)\W*$",
    r"^\W*access (?:is |was )?denied\b\W*$|\byou (?:do not|don't|need) (?:have )?permission\b|\bpermission denied\W*$",
    r"\bsomething went wrong\b|\b(?:request|connection|session|gateway) (?:has )?(?:timed out|time-?out|expired)\b|\bgateway timeout\b|^\W*too many requests\b",
    r"\b(?:site|page|server|service|system) is (?:currently |temporarily )?(?:down|unavailable|offline|under maintenance)\b",
    r"^\W*(?:fatal error|warning|notice|parse error|uncaught \w+)\s*:|\btraceback\b.*\bmost recent call\b|\b\w+(?:error|exception)\s*:|\bupstream (?:did not|timed|connect)",
    r"\b(?:verif|check)\w+ (?:that |if |whether )?you are (?:a )?human\b|\bare you a (?:robot|human)\b",
)

#: Notices that scripts or cookies are required.
NOTICES = (
    r"\b(?:enable|activate|allow|turn on|switch on|unblock)\b[^.]{0,12}\b(?:javascript|scripts?|cookies|js)\b",
    r"\b(?:javascript|scripts?|cookies)\b[^.]{0,30}\b(?:must|need|needs|has|have)\b[^.]{0,10}\bbe (?:enabled|allowed|activated|turned on|switched on)",
    r"\bbrowser\b[^.]{0,30}\b(?:javascript|scripts?|cookies)\b|\b(?:needs|requires|need|require) (?:javascript|scripts|cookies)(?=\W*$|\s*[,.;:]|\s+(?:to|enabled|and|or|in|for|support)\b)|\b(?:javascript|scripts?|cookies) (?:is|are) (?:disabled|required|blocked|turned off|switched off)",
    r"\b(?:activer|activez|autoriser)\b[^.]{0,20}\b(?:javascript|scripts?|cookies)\b|\b(?:javascript|scripts?|cookies)\b[^.]{0,20}\b(?:aktivieren|einschalten|erlauben|zulassen)\b|\bbenötigt (?:javascript|scripts?|cookies)|\b(?:active|habilite|activar|habilitar|permita)\b[^.]{0,12}\b(?:javascript|scripts?|cookies)\b|включите (?:javascript|скрипты|cookies)",
)

_SPAN = r"(?:\d+|a few|an?|some|several) (?:milli)?(?:seconds?|minutes?|hours?|moments?)"
_WHEN = rf"(?:again|later|soon|shortly|tomorrow|(?:in|after) {_SPAN})"

#: Whole segments that tell a reader what to do next.
ADVICE = (
    r"^\W*(?:(?:please|sorry|oops|slow down|wait|check (?:the|your) \w+|(?:reload|refresh) (?:the|this) page)\W+(?:(?:and|then|or)\W+)?)*"
    rf"(?:try|retry|reload|refresh|come back|check back)(?: (?:it|this|(?:the|this) page))? {_WHEN}(?: {_WHEN})?\W*$",
    rf"^\W*(?:this|it|loading)(?: page)? (?:may|might|can|could|will) take (?:up to )?{_SPAN}\W*$",
    r"^\W*(?:пожалуйста\W+)?(?:попробуйте|повторите попытку)\W+(?:позже|снова|ещё раз|еще раз)\W*$",
    r"^\W*bitte (?:schalten|aktivieren|versuchen|laden|prüfen|warten) sie\b[^.]*\W*$|^\W*veuillez (?:réessayer|patienter|recharger|vérifier)\b[^.]*\W*$",
)

#: Words that say nothing about a title.
FUNCTION_WORDS = (
    "a an the and or of in on at by to for from with as is are was were be it its this that und oder der die das den dem des ein eine "
    "von zu im am et ou le la les un une des du au aux y o el los las del de en и или в на с по из"
).split()

#: With function words, all that a segment meant for a reader need hold.
READER_WORDS = (
    "you your we our us please sorry oops will ll re can may might try again reload refresh sign log come back check take click here later "
    "soon shortly wait moment moments minute minutes second seconds few while not do if when working hang tight thank thanks patience "
    "visiting reference request id error code status warning bitte sie es ein sind wir gleich zurück wieder da veuillez désolé nous "
    "revenons bientôt пожалуйста попробуйте мы скоро вернёмся вернемся"
).split()

#: Signs that a segment speaks to a reader rather than about a thing.
LOOSE = (
    r"\b(?:you|your|we|our|us|please|sorry|oops|bitte|veuillez|désolé|пожалуйста|попробуйте)\b",
    r"\btry again\b|\breload\b|\bsign in\b|\blog in\b|\bcome back\b|\bcheck the\b|\bmay take\b|\bclick\b",
    r"^\W*(?:error|reference|request id|code|status|warning)\b[\W\d]*$|^\W*(?:test|asdf|qwerty|blah|foo|bar)\b",
)

#: Every detector above needs one of these words or signs, so its pattern is tried only where one stands.  Nothing else depends on them.
TRIGGER_WORDS = (
    "text content description title name here placeholder untitled added written filled done announced paragraph описание "
    "текст hier einfügen venir compléter ajouter aquí pendiente javascript script scripts cookie cookies js скрипты bad "
    "unauthorised unauthorized forbidden found gone allowed time timeout conflict requests internal implemented unavailable "
    "unknown http status code fehler erreur server seite página article file introuvable страница page denied permission "
    "wrong request connection session gateway site service system warning notice upstream human robot traceback fatal parse uncaught "
    "verify verifying you your we our us please sorry oops bitte veuillez désolé пожалуйста попробуйте try reload sign log "
    "come check take click reference test asdf qwerty blah foo bar todo"
).split()
TRIGGER_SIGNS = r"[{}<>\[\]%$@_|]|#[A-Z{]|\bNaN\b|\b(?:TODO|FIXME|TBD|TBA)\b|X{3}|(?i:x{4}|undefined|\bnull\b|\bnone\b|\bnil\b)"

#: Evidence.  A detector of a kind by itself; a term of the own title against an error; for words addressed to a reader: nothing
#: else said, other segments in the row, firm residue in the row; each doubling of titles and of hosts.  The sum must reach ``ENOUGH``.
FIRM = {"placeholder": 3.0, "filler": 2.5, "notice": 2.5, "error": 2.5}
OWN_TITLE, READER_ONLY, BESIDE_TEXT, BESIDE_FIRM, PER_TITLES, PER_HOSTS = -1.0, 1.1, 0.5, 0.5, 1.0, 0.25
ENOUGH = 1.58
#: A duplicated response without any detector: this much of titles and hosts, this part of its words' occurrences in it, and so many
#: content words in a description (a word or two may be shared by all records of a kind) or a sentence (headings recur as well).
ENOUGH_ALONE, CLOSED, DESC_WORDS, TEXT_WORDS = 2.25, 0.5, 4, 3


#: All but letters of scripts that write without blanks.
UNSPACED = r"[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsHangul}]+"


def _any(text: Column, patterns: tuple, flags: str = "") -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(flags + p) for p in patterns])


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))


def segments(merged: DataFrame) -> DataFrame:
    """``rec_id, host, title, _slug, field, seg, beside``: each non-blank sentence of desc and text, the title's terms and
    whether the row has others.

    Null and blank fields, paragraphs and sentences have none.  Only the columns
    named are read.
    """
    # the tokenised sentences of text are segments as they are; a description is cut at its sentence ends
    parts = F.split(F.coalesce("desc", F.lit("")), r"(?<=[.!?])\s+(?=\S)|(?<=[。！？।])")
    desc = F.transform(parts, lambda s: F.struct(F.lit("desc").alias("field"), s.alias("seg")))
    sents = F.transform(
        F.flatten(F.filter("text", lambda p: p.isNotNull())), lambda s: F.struct(F.lit("text").alias("field"), s.alias("seg"))
    )
    empty = F.array().cast("array<struct<field:string,seg:string>>")
    filled = F.filter(F.concat(desc, F.coalesce(sents, empty)), lambda x: F.trim(x["seg"]) != "")
    return (
        merged.select("rec_id", F.col("source").alias("host"), F.coalesce("title", "name").alias("title"), filled.alias("_all"))
        .withColumn("_slug", _slug())
        .select("rec_id", "host", "title", "_slug", (F.size(F.array_distinct("_all.seg")) > 1).alias("beside"), F.explode("_all").alias("x"))
        .select("rec_id", "host", "title", "_slug", "x.field", "x.seg", "beside")
    )


def _slug() -> Column:
    return F.array_except(_words(F.regexp_replace(F.coalesce("title", F.lit("")), "_", " ")), F.lit(FUNCTION_WORDS))


def graded(segs: DataFrame) -> DataFrame:
    """All segments with what the detectors and the terms say.

    ``firm`` (kind of residue or null), ``loose`` (words addressed to a reader),
    ``reader`` (nothing but such), ``shape`` (hash of the distinct words but the slug's
    terms, and of the numbers), ``own`` (shares a term with its slug), ``terms`` (its
    distinct content words), ``size`` (their number, as far as it matters).
    """
    s, w = F.col("seg"), F.col("_w")
    known = [*TRIGGER_WORDS, *FILLER_LATIN]
    repeats = (F.size(w) >= 2) & (F.element_at(w, 1) == F.element_at(w, -1))
    called = repeats | F.exists(w, lambda x: x.isin(known) | x.endswith("error") | x.endswith("exception")) | s.rlike(TRIGGER_SIGNS)
    latin = F.size(F.filter(w, lambda x: x.isin(FILLER_LATIN)))
    all_latin = (latin >= 3) & (latin * 2 >= F.size(w))
    # one word over and over: three times, or twice in lower case
    same = (F.size(F.array_distinct(w)) == 1) & ((F.size(w) >= 3) | ((F.size(w) == 2) & ~s.rlike(r"\p{Lu}")))
    firm = (
        F.when(~F.col("_called"), None)
        .when(_any(s, PLACEHOLDERS), "placeholder")
        .when(all_latin | same | _any(s, FILLERS, "(?iU)"), "filler")
        .when(_any(s, NOTICES, "(?iU)"), "notice")
        .when(_any(s, ADVICE, "(?iU)") & ~F.arrays_overlap(w, F.col("_slug")), "notice")
        .when(_any(s, ERRORS, "(?iU)") & ~s.rlike(r"(?i)\bshows? (?:an |the )?error"), "error")
    )
    numbers = F.when(s.rlike("[0-9]"), F.regexp_replace(s, "[^0-9]+", " ")).otherwise("")
    return (
        segs.withColumn("_w", _words(s))
        .withColumns({"_called": called, "_distinct": F.array_distinct(w)})
        .withColumns({"_rest": F.array_except("_distinct", "_slug"), "terms": F.filter("_distinct", lambda x: ~x.isin(FUNCTION_WORDS))})
        .withColumn("loose", F.col("_called") & _any(s, LOOSE, "(?iU)"))
        .select(
            "rec_id", "field", "host", F.xxhash64("title").alias("title"), "beside", firm.alias("firm"), "loose",
            (F.col("loose") & (F.size(F.array_except(w, F.lit([*READER_WORDS, *FUNCTION_WORDS]))) == 0) & (_any(s, LOOSE[:2], "(?iU)") | s.rlike(r"\d"))).alias("reader"),
            F.xxhash64(F.array_join("_rest", " "), numbers).alias("shape"), (F.size("_rest") < F.size("_distinct")).alias("own"),
            "terms",
            # scripts without blanks: three letters pass for a word
            F.when(F.size("terms") >= DESC_WORDS, F.size("terms"))
            .otherwise((F.size("terms") + F.length(F.regexp_replace(s, UNSPACED, "")) / 3).cast("int"))
            .alias("size"),
        )
    )


def _repeated(g: DataFrame) -> DataFrame:
    """Segments without a detector's name whose shape stands under several titles: with ``titles``, ``hosts`` and ``closed``.

    ``closed`` is how far the terms of the shape occur in it only: the mean, over its
    terms, of the part that this shape has in all segments that hold the term.
    """
    open_ = g.where("firm is null")
    per_shape = open_.groupBy("shape").agg(F.count(F.lit(1)).alias("n"), F.min("title").alias("_a"), F.max("title").alias("_b"), F.max("terms").alias("terms"))
    several = stage(per_shape.where("_a <> _b").select("shape", "n", "terms"), "several")
    dup = stage(salted_lookup(open_, several.select("shape"), "shape", F.col("rec_id"), hot_counts(several, "shape", "n", 50_000)), "dup")
    # an unknown host is none
    seen = (
        dup.select("shape", "title", "host").distinct().groupBy("shape")
        .agg(F.count_distinct("title").alias("titles"), F.greatest(F.count_distinct("host"), F.lit(1)).alias("hosts"))
    )
    everywhere = g.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("_all"))
    closed = (
        several.select("shape", "n", F.explode("terms").alias("term")).join(everywhere, "term")
        .groupBy("shape").agg(F.avg(F.col("n") / F.col("_all")).alias("closed"))
    )
    facts = seen.join(closed, "shape", "left").select("shape", "titles", "hosts", F.coalesce("closed", F.lit(0.0)).alias("closed"))
    return salted_lookup(dup, facts, "shape", F.col("rec_id"), hot_counts(several, "shape", "n", 50_000))


def find_residue(merged: DataFrame) -> DataFrame:
    """``rec_id, field, kind``: fields that hold residue in any segment.

    ``kind`` is the first in the order placeholder, filler, notice, error, duplicate.
    Repeated rows count as records of their own but as one title in the evidence.
    Empty tables give no rows.
    """
    g = stage(graded(segments(merged)), "graded")
    own = F.col("own") & (F.col("firm") == "error")
    weight = F.create_map(*[F.lit(x) for kv in FIRM.items() for x in kv])[F.col("firm")] + own.cast("double") * OWN_TITLE
    firm = g.where("firm is not null").where(weight >= ENOUGH).select("rec_id", "field", F.col("firm").alias("kind"))
    dup = stage(_repeated(g), "repeated")
    spread = F.log2("titles") * PER_TITLES + F.log2("hosts") * PER_HOSTS
    # words addressed to a reader: with or without other titles
    single = g.where("firm is null and loose and not own").join(dup.select("shape").distinct(), "shape", "left_anti")
    reader = dup.where("loose and not own").select("rec_id", "field", "reader", "beside", spread.alias("_spread")).unionByName(
        single.select("rec_id", "field", "reader", "beside", F.lit(0.0).alias("_spread"))
    )
    said = F.col("reader").cast("double") * (READER_ONLY + F.col("beside").cast("double") * BESIDE_TEXT)
    in_row = firm.select("rec_id", F.lit(BESIDE_FIRM).alias("_firm")).distinct()
    addressed = reader.join(in_row, "rec_id", "left").where(said + F.coalesce("_firm", F.lit(0.0)) + F.col("_spread") >= ENOUGH)
    # responses no detector knows: closed vocabulary, nothing of the own title or body
    least = F.when(F.col("field") == "desc", DESC_WORDS).otherwise(TEXT_WORDS)
    alone = dup.where(~F.col("own") & (F.col("closed") >= CLOSED) & (F.col("hosts") > 1) & (spread >= ENOUGH_ALONE) & (F.col("size") >= least))
    body = g.select("rec_id", F.col("shape").alias("_other"), F.col("terms").alias("_body"))
    known = alone.join(body, "rec_id").where((F.col("shape") != F.col("_other")) & F.arrays_overlap("terms", "_body"))
    unknown = alone.join(known.select("rec_id", "shape").distinct(), ["rec_id", "shape"], "left_anti")
    kinds = [firm, *(d.select("rec_id", "field", F.lit("duplicate").alias("kind")) for d in (addressed, unknown))]
    order = F.create_map(*[F.lit(x) for i, k in enumerate((*FIRM, "duplicate")) for x in (k, i)])
    return reduce(DataFrame.unionByName, kinds).groupBy("rec_id", "field").agg(F.min_by("kind", order[F.col("kind")]).alias("kind"))


def without_residue(merged: DataFrame, found: DataFrame) -> DataFrame:
    """``merged`` without the rows of which some field holds residue."""
    return merged.join(found.select("rec_id").distinct(), "rec_id", "left_anti")
