"""Searches over the originals by word form and by lemma, and citations of their places."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import cite, index, joins, stats
from quire.sources.tables import read

# Nouns of the units that each scheme counts; schemes whose columns are shared between works.
UNITS = {"bekker": "column", "stephanus": "column", "section": "section", "book-section": "section", "verse-line": "line", "dk": "fragment"}
SHARED = ("bekker", "stephanus")
GREEK, LATIN = ["βασιλεύς", "ἱερεύς", "ναύτης"], ["rex", "regem"]


def source_words(c: Column) -> Column:
    """Runs of letters with their marks, as they stand."""
    return F.regexp_extract_all(c, F.lit(r"[\p{L}\p{M}]+"), F.lit(0))


def source_key(c: Column) -> Column:
    """Form key of any script: no accents, lower case, one sigma."""
    return F.translate(T.strip_accents(F.lower(c)), "ς", "σ")


def _g(s, d, *more):
    return read(s, d, "gsents").where("sent_id is not null").select("sent_id", "chapter_id", "work_id", "lang", "text", *more).distinct()


def _forms(s, d):
    """(seg, chapter_id, work_id, lang, pos, term, key) of the Greek and Latin originals."""
    g = _g(s, d).where("lang in ('grc', 'lat')")
    return index.postings(g, "sent_id", "text", ["chapter_id", "work_id", "lang"], source_words).withColumn("key", source_key(F.col("term")))


def _lemmata(s, d):
    a = read(s, d, "analyses").where("lang in ('grc', 'lat') and lemma is not null and form is not null")
    return a.select("lang", source_key(F.col("form")).alias("key"), source_key(F.col("lemma")).alias("head")).distinct()


def source_postings(s, d):
    """The form index of the originals."""
    return _forms(s, d).groupBy("lang", "key").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("seg").alias("segs"))


def lemma_postings(s, d):
    """The lemma index: a form stands under each of its lemmata, or under itself where the lexicon has none."""
    f = _forms(s, d).join(F.broadcast(_lemmata(s, d)), ["lang", "key"], "left").withColumn("head", F.coalesce("head", "key"))
    return f.groupBy("lang", "head").agg(F.countDistinct("seg", "pos").alias("n"), F.countDistinct("seg").alias("segs"))


def form_lemmata(s, d):
    """Forms that are no headword, with the sorted headwords that they belong to."""
    m = _lemmata(s, d)
    heads = m.select("lang", F.col("head").alias("key")).distinct()
    return m.join(heads, ["lang", "key"], "left_anti").groupBy("lang", "key").agg(F.array_join(F.array_sort(F.collect_set("head")), ",").alias("heads"))


def form_lemmata_wrong(s, d):
    """The contract of the map: entries that are empty, unsorted, or name themselves, counted beside all."""
    m = form_lemmata(s, d).withColumn("h", F.split("heads", ","))
    bad = (F.col("heads") == "") | (F.array_sort("h") != F.col("h")) | F.array_contains("h", F.col("key"))
    return m.agg(F.count(F.lit(1)).alias("entries"), F.sum(bad.cast("long")).alias("wrong"))


def _terms(s, words: list[str], lang: str):
    return s.createDataFrame([(i, lang, w) for i, w in enumerate(words)], "slot int, lang string, word string").withColumn("key", source_key(F.col("word")))


def _resolved(s, d, words: list[str], lang: str):
    """(slot, head): a term that is a headword stands for itself, any other for the headwords of its form, or else itself."""
    t, m = _terms(s, words, lang), _lemmata(s, d)
    heads = m.select("lang", F.col("head").alias("key"), F.lit(True).alias("own")).distinct()
    got = t.join(F.broadcast(heads), ["lang", "key"], "left").join(F.broadcast(m), ["lang", "key"], "left")
    return got.select("slot", F.when(F.col("own"), F.col("key")).otherwise(F.coalesce("head", "key")).alias("head")).distinct()


def resolve_terms(s, d):
    words = GREEK + ["βασιλέα", "ἵππον", "unknown"]
    return _resolved(s, d, words, "grc").select(F.col("slot").cast("long").alias("slot"), "head")


def source_phrase(s, d):
    """Places where the lemmata of a phrase follow one another, each slot by any of its headwords."""
    f = _forms(s, d).where("lang = 'lat'").join(F.broadcast(_lemmata(s, d)), ["lang", "key"], "left").withColumn("head", F.coalesce("head", "key"))
    slots = _resolved(s, d, ["in", "horto"], "lat")
    votes = f.join(F.broadcast(slots), "head").select("seg", (F.col("pos") - F.col("slot")).alias("pos"), "slot").distinct()
    return votes.groupBy("seg", "pos").agg(F.count(F.lit(1)).alias("n")).where("n = 2 and pos >= 0").select("seg", F.col("pos").cast("long").alias("pos"))


def source_prefix(s, d):
    return _forms(s, d).where(F.col("key").startswith("στρατ")).select("seg").distinct()


def both_languages(s, d):
    """Chapters where the original holds one of the Latin forms and the translation an English word, against those with either."""
    a = _forms(s, d).where(F.col("lang") == "lat").where(F.col("key").isin(LATIN)).select("chapter_id").distinct()
    b = index.postings(read(s, d, "chapter_refs").where("ross_text is not null"), "chapter_id", "ross_text").where("term = 'harbour'").select(F.col("seg").alias("chapter_id")).distinct()
    return a.join(b, "chapter_id", "left_semi").withColumn("op", F.lit("and")).unionByName(a.unionByName(b).distinct().withColumn("op", F.lit("or"))).where("chapter_id is not null")


def accent_filter(s, d):
    """Of the hits of a key without accents those whose own accents are as typed."""
    typed = F.lit("βασιλεύς")
    hit = _forms(s, d).where(F.col("key") == source_key(typed))
    return hit.groupBy((F.translate(F.lower("term"), "ς", "σ") == F.translate(typed, "ς", "σ")).alias("as_typed")).agg(F.count(F.lit(1)).alias("n"))


def chapter_cards(s, d):
    """Hits of a Greek word by work and chapter in the order of works and chapters, with how many each has."""
    hit = _forms(s, d).where(F.col("key") == source_key(F.lit(GREEK[0]))).groupBy("work_id", "chapter_id").agg(F.count(F.lit(1)).alias("n"))
    w = read(s, d, "works").select("work_id", "title")
    card = F.row_number().over(Window.partitionBy("work_id").orderBy("chapter_id"))
    return hit.join(F.broadcast(w), "work_id").select("title", "chapter_id", "n", card.cast("long").alias("card"))


def federated(s, d):
    """A search over named works; those that are not there are reported and skipped."""
    w = read(s, d, "works").select("work_id").where("lang = 'grc'").unionByName(s.createDataFrame([("no-such-work",)], "work_id string"))
    there = _forms(s, d).join(F.broadcast(w), "work_id", "left_semi")
    n = there.groupBy("work_id").agg(F.count(F.lit(1)).alias("words"), F.sum((F.col("key") == source_key(F.lit(GREEK[1]))).cast("long")).alias("hits"))
    return w.join(n, "work_id", "left").select("work_id", F.col("words").isNull().alias("skipped"), F.coalesce("hits", F.lit(0)).alias("hits"))


def lemma_suggest(s, d):
    """The five most frequent headwords that begin with what is typed."""
    n = lemma_postings(s, d).where((F.col("lang") == "grc") & F.col("head").startswith("στ"))
    return n.orderBy(F.col("n").desc(), "head").limit(5).select("head", "n")


def suggest(s, d):
    """Suggestions for a typed string from several sources, in the order of the sources: places, works, headwords, then the search itself."""
    typed = "a4"
    places = read(s, d, "chapter_refs").where(F.lower("citation").startswith(typed)).select(F.col("citation").alias("what")).distinct()
    titles = read(s, d, "works").where(F.contains(F.lower("title"), F.lit(typed))).select(F.col("title").alias("what"))
    heads = read(s, d, "analyses").where(F.lower("lemma").startswith(typed)).select(F.col("lemma").alias("what")).distinct()
    search = s.createDataFrame([(typed,)], "what string")
    return reduce(lambda x, y: x.unionByName(y), [t.select("what", F.lit(k).alias("kind"), F.lit(i).cast("long").alias("kind_rank")) for i, (k, t) in enumerate((("place", places), ("work", titles), ("headword", heads), ("search", search)))])


def query_script(s, d):
    """Typed words routed by script: Greek letters ask the originals, others the translations."""
    w = read(s, d, "analyses").select(F.col("form").alias("query")).distinct()
    return w.groupBy(F.when(T.is_greek(F.col("query")), "source").otherwise("translation").alias("route")).agg(F.count(F.lit(1)).alias("n"))


def query_parse(s, d):
    """Typed titles as search terms: split at white space, stars at the front of a term dropped, one at its end kept as a prefix sign."""
    q = read(s, d, "works").select(F.concat(F.lit("  **"), F.col("title"), F.lit("*  ")).alias("query"))
    t = q.select("query", F.posexplode(F.split(F.trim("query"), r"\s+")).alias("slot", "term")).withColumn("term", F.regexp_replace("term", r"^\*+", ""))
    return t.where("term <> ''").select("query", F.col("slot").cast("long").alias("slot"), T.fold(F.rtrim(F.col("term"), F.lit("*"))).alias("key"), F.col("term").endswith("*").alias("prefix"))


def kwic_marked(s, d):
    """Words about each hit, eight on each side, every hit in sight marked, with ellipses where text is left out."""
    docs = read(s, d, "documents").select("doc_id", T.words(F.col("text")).alias("w"))
    hit = docs.select("doc_id", "w", F.posexplode("w").alias("pos", "t")).where("t = 'harbour'")
    lo, hi = F.greatest(F.lit(0), F.col("pos") - 8), F.least(F.size("w"), F.col("pos") + 9)
    shown = F.array_join(F.transform(F.slice("w", lo + 1, hi - lo), lambda x: F.when(x == "harbour", F.concat(F.lit("<mark>"), x, F.lit("</mark>"))).otherwise(x)), " ")
    return hit.select("doc_id", F.col("pos").cast("long").alias("pos"), F.concat(F.when(lo > 0, "… ").otherwise(""), shown, F.when(hi < F.size("w"), " …").otherwise("")).alias("line"))


def position_line(s, d):
    """The printed line of each word of the originals, from the cumulative words of the chapter's lines."""
    lines = read(s, d, "chapter_refs").select("chapter_id", F.explode("greek_lines").alias("l")).select("chapter_id", F.col("l.cum_words").cast("long").alias("at"), F.col("l.citation").alias("line")).distinct()
    words = read(s, d, "gsents").where("chapter_id is not null and w_start is not null").select("sent_id", "chapter_id", F.col("w_start").cast("long").alias("at")).distinct()
    return joins.asof(words, lines, ["chapter_id"], "at", "line").select("sent_id", F.col("asof_line").alias("line"))


def offset_line(s, d):
    """The printed line of each anchor of a translation by its share of the text's length."""
    c = read(s, d, "chapter_refs").where("ref_text <> ''").select("chapter_id", "ref_text", "ref_anchors", "greek_lines").distinct().where("size(greek_lines) > 0")
    a = c.select("chapter_id", "greek_lines", F.length("ref_text").alias("len"), F.explode("ref_anchors").alias("a"))
    n = F.size("greek_lines")
    at = F.least(n - 1, F.floor(F.col("a.off") * n / F.col("len")).cast("int"))
    return a.select("chapter_id", F.col("a.citation").alias("anchor"), F.get("greek_lines", at)["citation"].alias("line"))


# citations


def _places(s, d):
    """(work_id, scheme, column, lo, hi): columns of the originals with their first and last line."""
    line = F.explode("lines").alias("l")
    p = read(s, d, "gsents").where("work_id is not null").select("work_id", line).distinct()
    p = p.select("work_id", F.regexp_extract("l", r"^(.*)\.(\d+)$", 1).alias("column"), F.regexp_extract("l", r"^(.*)\.(\d+)$", 2).cast("long").alias("n")).where("column <> ''")
    w = F.broadcast(read(s, d, "works").select("work_id", "scheme"))
    return p.groupBy("work_id", "column").agg(F.min("n").alias("lo"), F.max("n").alias("hi")).join(w, "work_id")


def citation_index(s, d):
    """Columns of the schemes that works share: each with the works that hold it and their lines."""
    return _places(s, d).where(F.col("scheme").isin(*SHARED)).select("column", "work_id", "lo", "hi")


def line_narrow(s, d):
    """Candidates of each (column, line): if all are of one scheme and any holds the line, those that hold it; else all."""
    p = _places(s, d)
    q = p.select("column", "lo").unionByName(p.select("column", F.col("hi").alias("lo"))).distinct().withColumnRenamed("lo", "line")
    c = q.join(p, "column").withColumn("holds", F.col("line").between(F.col("lo"), F.col("hi")))
    w = Window.partitionBy("column", "line")
    c = c.withColumn("narrow", (F.min("scheme").over(w) == F.max("scheme").over(w)) & F.max("holds").over(w))
    kept = c.where("holds or not narrow").groupBy("column", "line").agg(F.array_join(F.array_sort(F.collect_set("work_id")), ",").alias("works"), F.countDistinct("work_id").alias("n"))
    return kept.select("column", "line", "works", (F.col("n") > 1).alias("ambiguous"))


def qualifier_match(s, d):
    """Typed places with a work before them, by id or title, in any case: the longest qualifier that matches wins."""
    w = read(s, d, "works").select("work_id", F.explode(F.array(F.lower("work_id"), F.lower("title"))).alias("qualifier"))
    raw = read(s, d, "chapter_refs").where("citation is not null").select("work_id", "citation").distinct().join(F.broadcast(read(s, d, "works").select("work_id", "title")), "work_id")
    raw = raw.select(F.explode(F.array(F.concat_ws(" ", F.upper("title"), "citation"), F.concat(F.col("work_id"), F.lit(", "), F.col("citation")))).alias("raw")).distinct()
    # Every prefix that ends before a space is looked up by equality.
    parts = F.split("raw", " ")
    tall = raw.select("raw", parts.alias("p")).select("raw", "p", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"))
    tall = tall.select("raw", F.rtrim(F.lower(F.array_join(F.slice("p", F.lit(1), F.col("k")), " ")), F.lit(",")).alias("qualifier"), F.array_join(F.slice("p", F.col("k") + 1, F.size("p")), " ").alias("place"))
    hit = tall.join(F.broadcast(w), "qualifier")
    return hit.groupBy("raw").agg(F.max_by(F.struct("work_id", "place"), F.struct(F.length("qualifier"), "work_id")).alias("b")).select("raw", "b.work_id", "b.place")


_DK = r"(?i)^(?:dk\s+)?(\d+)\s*([ab])\s*(\d+)([a-z]?)(?:\.(\d+))?$"


def dk_citations(s, d):
    """Fragment citations in full (chapter, series, number, letter, line) from the places of fragments."""
    f = read(s, d, "fragments").where("column_key is not null and frag_id is not null").select("work_id", "column_key").distinct()
    raw = F.concat(F.lit("DK "), (F.length("work_id") + 14).cast("string"), F.lit(" "), F.lower("column_key"), F.when(F.length("column_key") > 3, ".7").otherwise(""))
    part = [F.regexp_extract("raw", _DK, k) for k in range(1, 6)]
    return f.select(raw.alias("raw")).distinct().where(F.col("raw").rlike(_DK)).select(
        "raw", part[0].cast("long").alias("chapter"), F.upper(part[1]).alias("series"), part[2].cast("long").alias("number"), F.lower(part[3]).alias("letter"), F.expr("try_cast(nullif(regexp_extract(raw, '" + _DK.replace("\\", "\\\\") + "', 5), '') as bigint)").alias("line")
    )


def homographs(s, d):
    """Citations that read both as a fragment of a collection and as a column of another work: both readings are kept."""
    c = read(s, d, "chapter_refs").where("citation is not null and work_id is not null").select("work_id", "citation").distinct()
    f = read(s, d, "fragments").where("column_key is not null and work_id is not null").select("work_id", F.col("column_key").alias("citation")).distinct()
    both = c.withColumn("reading", F.lit("column")).unionByName(f.withColumn("reading", F.lit("fragment")))
    return both.groupBy("citation").agg(F.countDistinct("reading").alias("readings"), F.countDistinct("work_id").alias("works")).where("readings > 1")


def scheme_by_work(s, d):
    """Each work's scheme as registered beside the form that most of its citations have."""
    c = read(s, d, "chapter_refs").where("citation is not null").select("work_id", "citation").distinct().withColumn("form", cite.scheme(F.col("citation")))
    n = c.groupBy("work_id", "form").agg(F.count(F.lit(1)).alias("n"))
    top = stats.top_k(n, ["work_id"], [F.col("n").desc(), F.col("form").asc_nulls_last()], 1)
    return read(s, d, "works").select("work_id", "scheme").join(top.select("work_id", "form"), "work_id", "left")


def cite_ranges(s, d):
    """Ranges in copied form: one place where both ends are the same."""
    g = read(s, d, "gsents").where("size(lines) > 0 and work_id is not null").select("sent_id", "work_id", F.element_at("lines", 1).alias("a"), F.element_at("lines", -1).alias("b")).distinct()
    return g.select("sent_id", F.concat(F.lit("("), "work_id", F.lit(" "), "a", F.when(F.col("a") != F.col("b"), F.concat(F.lit("–"), F.col("b"))).otherwise(""), F.lit(")")).alias("label"))


def unit_nouns(s, d):
    """How many units a work has, with its scheme's noun in the right number; a scheme without one counts chapters."""
    nouns = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    w = read(s, d, "works").select("work_id", F.coalesce(F.element_at(nouns, F.col("scheme")), F.lit("chapter")).alias("noun"), F.col("n_books").cast("long").alias("n"))
    return w.select("work_id", F.concat_ws(" ", F.col("n").cast("string"), F.concat(F.col("noun"), F.when(F.col("n") == 1, "").otherwise("s"))).alias("label"))


def route_rows(s, d):
    """Addresses of works, books and chapters, with how many rows claim each."""
    w = read(s, d, "works").select(F.concat(F.lit("/"), F.col("work_id")).alias("route"))
    c = read(s, d, "chapter_refs").where("work_id is not null and book is not null and chapter is not null").select("chapter_id", "work_id", "book", "chapter").distinct()
    b = c.select("work_id", "book").distinct().select(F.concat_ws("/", F.lit(""), "work_id", F.col("book").cast("string")).alias("route"))
    p = c.select(F.concat_ws("/", F.lit(""), "work_id", F.col("book").cast("string"), "chapter").alias("route"))
    return w.unionByName(b).unionByName(p).groupBy("route").agg(F.count(F.lit(1)).alias("claims"))


def route_collisions(s, d):
    return route_rows(s, d).where("claims > 1")


def verse_keys(s, d):
    """Order keys of places such as 12, 12a and 7.12: numbers as numbers, a letter behind."""
    c = read(s, d, "chapter_refs").where("citation rlike '^[0-9]+[a-z]?$'").select("citation").distinct()
    n = F.regexp_extract("citation", r"^(\d+)", 1).cast("long")
    return c.select("citation", (n * 27 + F.coalesce(F.ascii(F.nullif(F.regexp_extract("citation", "([a-z])$", 1), F.lit(""))) - 96, F.lit(0))).alias("key"))


def line_positions(s, d):
    """Places such as 219d.6 as whole numbers: (page * 2 + side) * 100000 + line, side by its letter."""
    l = read(s, d, "gsents").select(F.explode("lines").alias("l")).distinct().where(F.col("l").rlike(r"^\d+[a-e]\.\d+$"))
    page, side, n = (F.regexp_extract("l", r"^(\d+)([a-e])\.(\d+)$", k) for k in (1, 2, 3))
    return l.select("l", ((page.cast("long") * 5 + F.ascii(side) - 97) * 100000 + n.cast("long")).alias("position"))


_KEY = "translate(strip_accents(lower({x})), 'ς', 'σ')"
_GS = "(select distinct sent_id, chapter_id, work_id, lang, text from gsents where sent_id is not null)"
_F = f"(select seg, chapter_id, work_id, lang, w[i] as term, i - 1 as pos, {_KEY.format(x='w[i]')} as key from (select sent_id as seg, chapter_id, work_id, lang, w, unnest(range(1, len(w) + 1)) as i from (select *, regexp_extract_all(text, '[\\p{{L}}\\p{{M}}]+') as w from {_GS} where lang in ('grc', 'lat'))))"
_L = f"(select distinct lang, {_KEY.format(x='form')} as key, {_KEY.format(x='lemma')} as head from analyses where lang in ('grc', 'lat') and lemma is not null and form is not null)"
_LP = f"(select f.*, coalesce(l.head, f.key) as head from {_F} f left join {_L} l on f.lang = l.lang and f.key = l.key)"
_FL = f"(select lang, key, string_agg(distinct head, ',' order by head) as heads from {_L} l where not exists (select 1 from {_L} h where h.lang = l.lang and h.head = l.key) group by all)"
_SLOTS = "(select distinct t.slot, case when exists (select 1 from {l} h where h.lang = '{lang}' and h.head = t.key) then t.key else coalesce(m.head, t.key) end as head from (select {k} as key, slot, word from (values {v}) as v(slot, word)) t left join (select * from {l} where lang = '{lang}') m on m.key = t.key)"


def _slots(words: list[str], lang: str) -> str:
    return _SLOTS.format(l=_L, lang=lang, k=_KEY.format(x="word"), v=", ".join(f"({i}, '{w}')" for i, w in enumerate(words)))


_P = "(select p.*, w.scheme from (select work_id, regexp_extract(l, '^(.*)\\.(\\d+)$', 1) as \"column\", min(cast(regexp_extract(l, '^(.*)\\.(\\d+)$', 2) as bigint)) as lo, max(cast(regexp_extract(l, '^(.*)\\.(\\d+)$', 2) as bigint)) as hi from (select distinct work_id, unnest(lines) as l from gsents where work_id is not null) where regexp_matches(l, '^(.+)\\.(\\d+)$') group by 1, 2) p join works w using (work_id))"
_RAW = "(select distinct raw from (select upper(title) || ' ' || citation as raw from chapter_refs join works using (work_id) where citation is not null union all select work_id || ', ' || citation from chapter_refs join works using (work_id) where citation is not null))"
_C = "(select distinct chapter_id, work_id, book, chapter from chapter_refs where work_id is not null and book is not null and chapter is not null)"
_ROUTES = f"(select '/' || work_id as route from works union all select * from (select distinct '/' || work_id || '/' || book from {_C}) union all select '/' || work_id || '/' || book || '/' || chapter from {_C})"
_DKRAW = "(select distinct 'DK ' || (length(work_id) + 14) || ' ' || lower(column_key) || case when length(column_key) > 3 then '.7' else '' end as raw from fragments where column_key is not null and frag_id is not null and work_id is not null)"
_FORM = "case " + " ".join(f"when regexp_matches(citation, '{v}') then '{k}'" for k, v in cite.FORMS.items()) + " end"
SQL = {
    "source_postings": f"select lang, key, count(*) as n, count(distinct seg) as segs from {_F} group by lang, key",
    "lemma_postings": f"select lang, head, count(distinct (seg, pos)) as n, count(distinct seg) as segs from {_LP} group by lang, head",
    "form_lemmata": f"select lang, key, heads from {_FL}",
    "form_lemmata_wrong": f"select count(*) as entries, cast(sum(case when list_contains(string_split(heads, ','), key) then 1 else 0 end) as bigint) as wrong from {_FL}",
    "resolve_terms": "select cast(slot as bigint) as slot, head from " + _slots(GREEK + ["βασιλέα", "ἵππον", "unknown"], "grc"),
    "source_phrase": f"with p as (select seg, pos, slot from (select * from {_LP} where lang = 'lat') join {_slots(['in', 'horto'], 'lat')} using (head)) select distinct a.seg, a.pos from p a join p b on a.seg = b.seg and b.pos = a.pos + 1 where a.slot = 0 and b.slot = 1",
    "source_prefix": f"select distinct seg from {_F} where key like 'στρατ%'",
    "both_languages": f"with a as (select distinct chapter_id from {_F} where lang = 'lat' and key in ('rex', 'regem') and chapter_id is not null), b as (select distinct chapter_id from chapter_refs where list_contains(regexp_extract_all(lower(ross_text), '([a-z'']+)', 1), 'harbour')) select chapter_id, 'and' as op from a where chapter_id in (from b) union all (select chapter_id, 'or' from (from a union from b))",
    "accent_filter": f"select translate(lower(term), 'ς', 'σ') = 'βασιλεύσ' as as_typed, count(*) as n from {_F} where key = 'βασιλευσ' group by 1",
    "chapter_cards": f"select title, chapter_id, n, row_number() over (partition by work_id order by chapter_id nulls first) as card from (select work_id, chapter_id, count(*) as n from {_F} where key = 'βασιλευσ' group by all) join works using (work_id)",
    "federated": f"select w.work_id, count(f.seg) = 0 as skipped, cast(coalesce(sum(case when key = 'ιερευσ' then 1 else 0 end), 0) as bigint) as hits from (select work_id from works where lang = 'grc' union all select 'no-such-work') w left join {_F} f on f.work_id = w.work_id group by w.work_id",
    "lemma_suggest": f"select head, count(distinct (seg, pos)) as n from {_LP} where lang = 'grc' and head like 'στ%' group by head order by n desc, head limit 5",
    "suggest": "select distinct citation as what, 'place' as kind, 0 as kind_rank from chapter_refs where starts_with(lower(citation), 'a4') union all select title, 'work', 1 from works where contains(lower(title), 'a4') union all select distinct lemma, 'headword', 2 from analyses where starts_with(lower(lemma), 'a4') union all select 'a4', 'search', 3",
    "query_script": "select case when regexp_matches(form, '\\p{Greek}') then 'source' else 'translation' end as route, count(distinct form) as n from analyses group by 1",
    "query_parse": "select query, slot, replace(replace(strip_accents(lower(rtrim(term, '*'))), 'v', 'u'), 'j', 'i') as key, ends_with(term, '*') as prefix from (select query, i - 1 as slot, ltrim(p[i], '*') as term from (select query, p, unnest(range(1, len(p) + 1)) as i from (select '  **' || title || '*  ' as query, regexp_split_to_array(trim('  **' || title || '*  '), '\\s+') as p from works))) where term <> ''",
    "kwic_marked": "select doc_id, pos, case when pos > 8 then '… ' else '' end || array_to_string(list_transform(w[greatest(1, pos - 7):pos + 9], lambda x: case when x = 'harbour' then '<mark>harbour</mark>' else x end), ' ') || case when pos + 9 < len(w) then ' …' else '' end as line from (select doc_id, w, unnest(range(len(w))) as pos from (select doc_id, regexp_extract_all(lower(text), '([a-z'']+)', 1) as w from documents)) where w[pos + 1] = 'harbour'",
    "position_line": "select distinct g.sent_id, last_line as line from (select distinct sent_id, chapter_id, w_start from gsents where chapter_id is not null and w_start is not null) g left join lateral (select arg_max(l.citation, l.cum_words) as last_line from (select distinct chapter_id, unnest(greek_lines) as l from chapter_refs) c where c.chapter_id = g.chapter_id and l.cum_words <= g.w_start) on true",
    "offset_line": "select chapter_id, a.citation as anchor, greek_lines[least(len(greek_lines), cast(floor(a.off * len(greek_lines) / length(ref_text)) as int) + 1)].citation as line from (select chapter_id, greek_lines, ref_text, unnest(ref_anchors) as a from (select distinct chapter_id, ref_text, ref_anchors, greek_lines from chapter_refs where ref_text <> '' and len(greek_lines) > 0))",
    "citation_index": f'select "column", work_id, lo, hi from {_P} where scheme in {SHARED}',
    "line_narrow": f'with q as (select distinct "column", line from (select "column", lo as line from {_P} union all select "column", hi from {_P})), c as (select q."column", line, work_id, line between lo and hi as holds, min(scheme) over w = max(scheme) over w and bool_or(line between lo and hi) over w as narrow from q join {_P} p on p."column" = q."column" window w as (partition by q."column", line)) select "column", line, string_agg(distinct work_id, \',\' order by work_id) as works, count(distinct work_id) > 1 as ambiguous from c where holds or not narrow group by "column", line',
    "qualifier_match": f"select raw, arg_max(work_id, (length(q), work_id)) as work_id, arg_max(ltrim(substring(raw, length(q) + 1), ', '), (length(q), work_id)) as place from {_RAW} join (select work_id, unnest([lower(work_id), lower(title)]) as q from works) on starts_with(lower(raw), q || ' ') or starts_with(lower(raw), q || ', ') group by raw",
    "dk_citations": "select raw, cast(regexp_extract(raw, r, 1) as bigint) as chapter, upper(regexp_extract(raw, r, 2)) as series, cast(regexp_extract(raw, r, 3) as bigint) as number, lower(regexp_extract(raw, r, 4)) as letter, try_cast(nullif(regexp_extract(raw, r, 5), '') as bigint) as line from (select raw, '{r}' as r from {t}) where regexp_matches(raw, '{r}')".replace("{t}", _DKRAW).replace("raw, r, ", "raw, '{r}', ").replace(", '{r}' as r", "").replace("{r}", _DK),
    "homographs": "select citation, count(distinct reading) as readings, count(distinct work_id) as works from (select work_id, citation, 'column' as reading from chapter_refs where citation is not null and work_id is not null union all select work_id, column_key, 'fragment' from fragments where column_key is not null and work_id is not null) group by citation having count(distinct reading) > 1",
    "scheme_by_work": f"select w.work_id, w.scheme, form from works w left join (select work_id, form, row_number() over (partition by work_id order by n desc, form nulls last) as r from (select work_id, {_FORM} as form, count(*) as n from (select distinct work_id, citation from chapter_refs where citation is not null) group by all)) f on f.work_id = w.work_id and r = 1",
    "cite_ranges": "select sent_id, '(' || work_id || ' ' || a || case when a <> b then '–' || b else '' end || ')' as label from (select distinct sent_id, work_id, lines[1] as a, lines[-1] as b from gsents where len(lines) > 0 and work_id is not null)",
    "unit_nouns": "select work_id, n_books || ' ' || coalesce(map {" + ", ".join(f"'{k}': '{v}'" for k, v in UNITS.items()) + "}[scheme], 'chapter') || case when n_books = 1 then '' else 's' end as label from works",
    "route_rows": f"select route, count(*) as claims from {_ROUTES} group by route",
    "route_collisions": f"select route, count(*) as claims from {_ROUTES} group by route having count(*) > 1",
    "verse_keys": "select distinct citation, cast(regexp_extract(citation, '^(\\d+)', 1) as bigint) * 27 + case when regexp_matches(citation, '[a-z]$') then ascii(right(citation, 1)) - 96 else 0 end as key from chapter_refs where regexp_matches(citation, '^[0-9]+[a-z]?$')",
    "line_positions": "select distinct l, (cast(regexp_extract(l, '^(\\d+)', 1) as bigint) * 5 + ascii(regexp_extract(l, '([a-e])', 1)) - 97) * 100000 + cast(regexp_extract(l, '(\\d+)$', 1) as bigint) as position from (select unnest(lines) as l from gsents) where regexp_matches(l, '^\\d+[a-e]\\.\\d+$')",
}
QUERIES = {f.__name__: f for f in (source_postings, lemma_postings, form_lemmata, form_lemmata_wrong, resolve_terms, source_phrase, source_prefix, both_languages, accent_filter, chapter_cards, federated, lemma_suggest, suggest, query_script, query_parse, kwic_marked, position_line, offset_line, citation_index, line_narrow, qualifier_match, dk_citations, homographs, scheme_by_work, cite_ranges, unit_nouns, route_rows, route_collisions, verse_keys, line_positions)}
