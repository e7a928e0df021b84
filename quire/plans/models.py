"""Segments of text, evidence and notes, catalog models, release states and markup."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import joins
from quire.sources.tables import read

# Latin letters that stand for Greek ones in mixed words; a mark that parts inline tables.
FROM_LATIN, TO_GREEK = "AaBEeHIiKkMNOoPpTtvXxYyZ", "ΑαΒΕεΗΙιΚκΜΝΟοΡρΤτνΧχΥγΖ"
# Kinds of a bracketed note, tried in order; what none fits is a gloss.
BRACKETS = (("crossref", r"\b(?:p|pp|fr|cf|see|vgl|s|ed|cod|v)\.|\bsee\b"), ("date", r"\b\d{1,4}\s*(?:B\.C\.|A\.D\.)|^\d{3,4}$"), ("mark", r"^[^\p{L}\d]*$"), ("note", r"^\d+$"), ("greek", r"[Ͱ-Ͽἀ-῿]"))


def _c(s, d, *cols):
    return read(s, d, "chapter_refs").where("chapter_id is not null").select("chapter_id", *cols).distinct()


def _g(s, d, *cols):
    return read(s, d, "gsents").where("sent_id is not null").select("sent_id", *cols).distinct()


# segments


def gutter_ticks(s, d):
    """Ticks in the margin of translations: the first line and every fifth, placed by its share of the words; one for each offset."""
    c = _c(s, d, "ross_text", "greek_lines").where("ross_text <> '' and size(greek_lines) > 1")
    total = F.greatest(F.lit(1), F.array_max(F.transform("greek_lines", lambda x: x["cum_words"])))
    t = c.select("chapter_id", F.length("ross_text").alias("len"), total.alias("total"), F.posexplode("greek_lines").alias("i", "l")).where("i = 0 or (i + 1) % 5 = 0")
    t = t.select("chapter_id", "i", F.col("l.citation").alias("line"), F.floor(F.col("l.cum_words") * F.col("len") / F.col("total")).alias("offset"))
    return t.groupBy("chapter_id", "offset").agg(F.min_by("line", "i").alias("line"))


def tick_sources(s, d):
    """Lines of translated chapters: those that an anchor places, and those whose place is estimated."""
    c = _c(s, d, "ref_text", "ref_anchors", "greek_lines").where("ref_text <> ''")
    a = c.select("chapter_id", F.explode("ref_anchors").alias("a")).select("chapter_id", F.replace("a.citation", F.lit("+"), F.lit(".")).alias("line")).distinct()
    l = c.select("chapter_id", F.explode("greek_lines").alias("l")).select("chapter_id", F.col("l.citation").alias("line")).distinct()
    return l.join(a.withColumn("real", F.lit(True)), ["chapter_id", "line"], "left").groupBy(F.coalesce("real", F.lit(False)).alias("real")).agg(F.count(F.lit(1)).alias("n"))


def snap_sentence(s, d):
    """Anchors moved to the nearest start of a sentence within twelve characters; of two as near, the earlier."""
    c = _c(s, d, "ref_anchors", "ref_sents")
    a = c.select("chapter_id", "ref_sents", F.explode("ref_anchors").alias("a")).select("chapter_id", "ref_sents", F.col("a.citation").alias("anchor"), F.col("a.off").alias("off"))
    near = F.array_min(F.transform(F.filter("ref_sents", lambda x: F.abs(x["off_start"] - F.col("off")) <= 12), lambda x: F.struct(F.abs(x["off_start"] - F.col("off")).alias("d"), x["off_start"].alias("o"))))
    return a.select("chapter_id", "anchor", F.coalesce(near["o"], F.col("off")).cast("long").alias("off")).distinct()


def clamp_anchors(s, d):
    """Anchors that never fall back: each at least at the last before it, with whether it was moved."""
    a = _c(s, d, "ref_anchors").select("chapter_id", F.posexplode("ref_anchors").alias("i", "a"))
    top = F.max("a.off").over(Window.partitionBy("chapter_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return a.select("chapter_id", F.col("i").cast("long").alias("i"), top.cast("long").alias("off"), (top > F.col("a.off")).alias("moved"))


def anchor_confidence(s, d):
    """Anchors by tier and by how sure they are: chapters certain, others by their distance from the one before."""
    a = _c(s, d, F.length("ref_text").alias("len"), "ref_anchors").select("chapter_id", "len", F.posexplode("ref_anchors").alias("i", "a"))
    gap = F.col("a.off") - F.lag("a.off").over(Window.partitionBy("chapter_id", "len").orderBy("i"))
    sure = F.when(F.col("a.tier") == "chapter", "certain").when(gap > 0.05 * F.col("len"), "reliable").otherwise("uncertain")
    return a.select(F.col("a.tier").alias("tier"), sure.alias("confidence")).groupBy("tier", "confidence").agg(F.count(F.lit(1)).alias("n"))


def explicit_chapters(s, d):
    """Chapters as marked: their first and last line and whether they begin a book."""
    c = _c(s, d, "work_id", "book", "chapter", "greek_lines").where("work_id is not null and book is not null and size(greek_lines) > 0")
    first = F.row_number().over(Window.partitionBy("work_id", "book").orderBy("chapter_id")) == 1
    return c.select("chapter_id", "work_id", "book", "chapter", F.element_at("greek_lines", 1)["citation"].alias("lo"), F.element_at("greek_lines", -1)["citation"].alias("hi"), first.alias("book_start"))


def compound_lines(s, d):
    """Originals parted at raised dots into numbered pieces."""
    g = _g(s, d, "text").where("contains(text, '·')")
    return g.select("sent_id", F.posexplode(F.split("text", "·")).alias("piece", "part")).select("sent_id", F.col("piece").cast("long").alias("piece"), F.trim("part").alias("part"))


def greek_sentences(s, d):
    """Greek originals cut at hard ends (period, question mark) and, within, at soft ones (raised dot), counted."""
    g = _g(s, d, "lang", "text").where("lang = 'grc' and text <> ''")
    hard = F.size(F.regexp_extract_all("text", F.lit(r"[^.;;]*[\p{L}\d][^.;;]*"), F.lit(0)))
    soft = F.size(F.regexp_extract_all("text", F.lit(r"[^.;;·]*[\p{L}\d][^.;;·]*"), F.lit(0)))
    return g.select("sent_id", hard.cast("long").alias("sentences"), soft.cast("long").alias("cola"))


def sentence_blocks(s, d):
    """Blocks of a translation: each from the start of its sentence to the start of the next, the last to the end."""
    c = _c(s, d, "ross_text", "ross_sents").where("ross_text <> ''").select("chapter_id", "ross_text", F.explode("ross_sents").alias("x")).select("chapter_id", "ross_text", F.col("x.sent_id").alias("sent_id"), F.col("x.off_start").alias("a"))
    nxt = F.coalesce(F.lead("a").over(Window.partitionBy("chapter_id", F.md5("ross_text")).orderBy("a", "sent_id")), F.length("ross_text"))
    return c.select("sent_id", F.rtrim(F.regexp_replace(F.substring("ross_text", F.col("a") + 1, nxt - F.col("a")), r"\s+", " ")).alias("block")).distinct()


def paragraph_starts(s, d):
    """Line breaks of translations taken out, and where the paragraphs that they began start in what is left."""
    c = _c(s, d, "ross_text").where("ross_text <> ''")
    p = c.select("chapter_id", F.split("ross_text", "\n").alias("p")).select("chapter_id", "p", F.posexplode("p").alias("i", "x"))
    return p.select("chapter_id", F.length(F.array_join(F.slice("p", F.lit(1), F.col("i")), "")).cast("long").alias("at"), F.length("x").cast("long").alias("size"))


def gap_text(s, d):
    """What stands between two words of a text, the first of each."""
    t = F.regexp_extract("text", r"(?s)\bbecause\b(.*?)\bin\b", 1)
    return read(s, d, "documents").where("text rlike '(?s)\\\\bbecause\\\\b(.*?)\\\\bin\\\\b'").select("doc_id", T.collapse(t).alias("between"))


def wrap_lines(s, d):
    """Printed lines that end within a word: what stands before the mark, and the part to be repainted behind it."""
    n = read(s, d, "footnote_defs").where("def_id is not null and text is not null").select("def_id", F.regexp_replace("text", "\r", "").alias("t")).distinct()
    w = n.select("def_id", F.explode(F.regexp_extract_all("t", F.lit(r"([a-z]+-\n[a-z]+)"), F.lit(1))).alias("w"))
    return w.select("def_id", F.split("w", "-\n")[0].alias("head"), F.split("w", "-\n")[1].alias("tail")).distinct()


def passage_owners(s, d):
    """Chapters whose sentences do not stand together in the order of their work."""
    g = _g(s, d, "work_id", "chapter_id").where("work_id is not null and chapter_id is not null")
    new = (F.col("chapter_id") != F.lag("chapter_id").over(Window.partitionBy("work_id").orderBy("sent_id"))).cast("int")
    runs = g.withColumn("new", F.coalesce(new, F.lit(1))).groupBy("work_id", "chapter_id").agg(F.sum("new").alias("runs"))
    return runs.where("runs > 1")


# evidence and notes


def sigla(s, d):
    """Speaker labels brought to their base: no continuation, no punctuation, upper case; with how many spellings each has."""
    t = read(s, d, "new_turns").where("speaker is not null").select("speaker")
    base = F.upper(T.collapse(F.regexp_replace(F.regexp_replace("speaker", r"(?i)\(?\bcont(?:'d|inued)?\b\.?\)?|^\s*speaker\s*[—–:-]*", " "), r"[^\p{L}' ]+", " ")))
    return t.select(base.alias("base"), "speaker").where("base <> ''").groupBy("base").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("speaker").alias("spellings"))


def mixed_words(s, d):
    """Words of originals that mix Greek and Latin letters, repaired to Greek, by whether nothing Latin is left."""
    w = _g(s, d, "text").select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{M}]+"), F.lit(0))).alias("w")).distinct()
    mixed = w.where("w rlike '[A-Za-z]' and w rlike '[Ͱ-Ͽἀ-῿]'").select("w", F.translate("w", FROM_LATIN, TO_GREEK).alias("repaired"))
    return mixed.select("w", "repaired", (~F.col("repaired").rlike("[A-Za-z]")).alias("whole"))


def edition_notes(s, d):
    """Bracketed notes within fragments by kind; a bracket that holds the whole text is none."""
    f = read(s, d, "fragments").where("frag_id is not null").select("frag_id", "text").distinct()
    n = f.where(r"text not rlike '^\\s*[(\\[][^()\\[\\]]*[)\\]]\\s*$'").select("frag_id", F.explode(F.regexp_extract_all("text", F.lit(r"[(\[]([^()\[\]]*)[)\]]"), F.lit(1))).alias("note"))
    kind = F.when(F.col("note").rlike(BRACKETS[0][1]), BRACKETS[0][0])
    for k, p in BRACKETS[1:]:
        kind = kind.when(F.col("note").rlike(p), k)
    return n.groupBy(kind.otherwise("gloss").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def language_decisions(s, d):
    """Foreign runs within Greek originals against the decisions on record, by hash: runs without one, and decisions that nothing uses."""
    def runs(t):
        return t.select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z]{2,}(?:[ ,.]+[A-Za-z]{2,})*"), F.lit(0))).alias("run")).select(T.hash_key(F.col("run")).alias("key"), "run").distinct()

    used = runs(_g(s, d, "lang", "text").where("lang = 'grc'"))
    known = runs(read(s, d, "fragments").where("text rlike '[Ͱ-Ͽ]'"))
    return used.join(known, "key", "left_anti").select("key", F.lit("undecided").alias("problem")).unionByName(known.join(used, "key", "left_anti").select("key", F.lit("unused").alias("problem")))


def quote_evidence(s, d):
    """Fragments of Latin letters whose long words stand in the originals of their own work, against other works: the verdict."""
    f = read(s, d, "fragments").where("frag_id is not null and work_id is not null").select("frag_id", "work_id", F.explode(F.array_distinct(F.filter(T.words(F.col("text")), lambda x: F.length(x) >= 6))).alias("w")).distinct()
    g = _g(s, d, "work_id", "text").where("work_id is not null").select("work_id", F.explode(F.array_distinct(T.words(F.col("text")))).alias("w")).where("length(w) >= 6").distinct()
    at = g.groupBy("w").agg(F.countDistinct("work_id").alias("works"))
    hit = f.join(g.withColumn("own", F.lit(1)), ["work_id", "w"], "left").join(at, "w", "left")
    n = hit.groupBy("frag_id").agg(F.count("own").alias("agree"), F.sum((F.col("own").isNull() & F.col("works").isNotNull()).cast("long")).alias("elsewhere"), F.count(F.lit(1)).alias("probes"))
    verdict = F.when((F.col("agree") >= 3) & (F.col("agree") > F.col("elsewhere")), "supported").when(F.col("elsewhere") > F.col("agree"), "mismatch").otherwise("open")
    return n.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def citation_heads(s, d):
    """Heads of notes that refer to a work: the title, and the parts of the place."""
    n = read(s, d, "footnote_defs").where("def_id is not null and text is not null").select("def_id", T.collapse(F.col("text")).alias("t")).distinct()
    head = r"^(?:See|Cf\.) ([^,]+), (\d+)\.(\d+)"
    return n.where(F.col("t").rlike(head)).select("def_id", F.regexp_extract("t", head, 1).alias("title"), F.regexp_extract("t", head, 2).cast("long").alias("book"), F.regexp_extract("t", head, 3).cast("long").alias("number")).distinct()


# lexicon


def stub_entries(s, d):
    """Lexicon entries that only point elsewhere: no gloss, or one of three letters or fewer."""
    return read(s, d, "analyses").where("gloss is null or length(trim(gloss)) < 4").select("form", "lang", "lemma").distinct()


def lexicon_coverage(s, d):
    """Dictionary entries that readings refer to, without homonym numbers, that no lemma stands for."""
    a = read(s, d, "analyses")
    need = a.select("lang", F.explode("lsj").alias("e")).select("lang", F.regexp_replace("e", r"\d+$", "").alias("lemma")).distinct()
    return need.join(a.select("lang", "lemma").distinct(), ["lang", "lemma"], "left_anti")


def lexicon_missing(s, d):
    """Words of the originals of any language that the lexicon lacks, with how often they stand."""
    w = _g(s, d, "lang", "text").where("lang is not null").select("lang", F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{M}]+"), F.lit(0))).alias("w")).groupBy("lang", F.lower("w").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return w.join(F.broadcast(read(s, d, "analyses").select("lang", F.lower("form").alias("w")).distinct()), ["lang", "w"], "left_anti").where("n > 1")


# catalog and release


def author_groups(s, d):
    """Authors by the year in which their first work came out, and language."""
    w = read(s, d, "works").groupBy("author").agg(F.min(F.year("released_at")).alias("year"), F.min_by("lang", "released_at").alias("lang"), F.count(F.lit(1)).alias("works"))
    return w.groupBy("year", "lang").agg(F.count(F.lit(1)).alias("authors"), F.sum("works").alias("works")).select(F.col("year").cast("long").alias("year"), "lang", "authors", "works")


def work_groups(s, d):
    """Works of each author in order of release, with their number in all."""
    w = Window.partitionBy("author")
    return read(s, d, "works").select("work_id", F.row_number().over(w.orderBy("released_at", "work_id")).cast("long").alias("ord"), F.count(F.lit(1)).over(w).alias("of"))


def manifests(s, d):
    """The manifest of each work as JSON."""
    c = _c(s, d, "work_id").where("work_id is not null").groupBy("work_id").agg(F.count(F.lit(1)).alias("chapters"))
    w = read(s, d, "works").join(c, "work_id", "left")
    return w.select("work_id", F.to_json(F.struct("work_id", "title", "lang", "scheme", "n_books", F.coalesce("chapters", F.lit(0)).alias("chapters"), "corpus_version"), {"ignoreNullFields": "false"}).alias("manifest"))


def heading_at(s, d):
    """The chapter that a document's place falls in: the last of its work whose number is not above it."""
    docs = read(s, d, "documents").where("work_id is not null and locus rlike '^[0-9]{1,9}$'").select("doc_id", "work_id", F.col("locus").cast("long").alias("at"))
    c = _c(s, d, "work_id", "citation").where("work_id is not null and citation rlike '^[0-9]{1,9}$'").groupBy("work_id", F.col("citation").cast("long").alias("at")).agg(F.min("chapter_id").alias("chapter_id"))
    return joins.asof(docs, c, ["work_id"], "at", "chapter_id").select("doc_id", F.col("asof_chapter_id").alias("chapter_id"))


def book_headings(s, d):
    """The first heading of each book and how many chapters stand under it."""
    c = _c(s, d, "work_id", "book", "citation").where("work_id is not null and book is not null")
    return c.groupBy("work_id", "book").agg(F.min_by("citation", F.when(F.col("citation").isNotNull(), F.col("chapter_id"))).alias("heading"), F.countDistinct("chapter_id").alias("chapters"))


def orphans(s, d):
    """Children without a parent at each level: chapters without a work, sentences without a chapter, documents whose work is not shelved."""
    w = read(s, d, "works").select("work_id")
    c = _c(s, d, "work_id")
    parts = [("chapter", c.where("work_id is not null").join(w, "work_id", "left_anti")), ("sentence", _g(s, d, "chapter_id").where("chapter_id is not null").join(c.select("chapter_id"), "chapter_id", "left_anti")), ("document", read(s, d, "documents").where("work_id is not null").join(w, "work_id", "left_anti")), ("unshelved", w.join(c.where("work_id is not null").select("work_id"), "work_id", "left_anti"))]
    out = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("level"), "n") for k, t in parts]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def path_stops(s, d):
    """Reading paths by scheme: stops at works that are there, the first of them, and three at most shown."""
    w = read(s, d, "works")
    paths = w.groupBy("scheme").agg(F.array_sort(F.collect_list("work_id")).alias("stops")).select("scheme", F.posexplode(F.concat("stops", F.array(F.lit("gone-work")))).alias("ord", "work_id"))
    there = paths.join(F.broadcast(_c(s, d, "work_id").select("work_id").distinct()), "work_id", "left_semi")
    stops = F.array_sort(F.collect_list(F.struct("ord", "work_id")))
    return there.groupBy("scheme").agg(F.min_by("work_id", "ord").alias("first_stop"), F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.slice(stops, 1, 3), lambda x: x["work_id"]), ",").alias("shown"))


def held_works(s, d):
    """Rows of works that are held back (no version yet), by table: none of them may be released."""
    held = F.broadcast(read(s, d, "works").where("corpus_version is null").select("work_id"))
    out = [read(s, d, t).join(held, "work_id", "left_semi").agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("tbl"), "n") for t in ("documents", "chapter_refs", "fragments")]
    return out[0].unionByName(out[1]).unionByName(out[2])


def stable_bytes(s, d):
    """A hash of each work's documents that does not depend on the order of rows, beside their number."""
    docs = read(s, d, "documents").where("work_id is not null and text is not null").select("work_id", F.md5("text").alias("h"))
    n = docs.groupBy("work_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.conv(F.left("h", F.lit(8)), 16, 10).cast("long")).alias("total"), F.min("h").alias("lo"), F.max("h").alias("hi"))
    return n.select("work_id", "n", "total", F.left(F.md5(F.concat("lo", "hi")), F.lit(8)).alias("ends"))


# markup


def _html(s, d):
    return read(s, d, "documents").where("text is not null").select("doc_id", F.concat(F.lit('<!-- x --><div class="a" onclick="b()"><head>H</head>'), "text", F.lit('<note>n <b>m</b></note> tail<script>alert(1)</script><a href="/w" title="t">w</a></div>')).alias("html"))


def drop_subtrees(s, d):
    """Text of markup without notes, heads and scripts; what follows them is kept."""
    bare = F.regexp_replace(F.col("html"), r"(?is)<!--.*?-->|<(note|head|script)\b[^>]*>.*?</\1>", "")
    return _html(s, d).select("doc_id", T.collapse(F.regexp_replace(bare, r"(?s)</?[A-Za-z][^>]*>", " ")).alias("text"))


def safe_markup(s, d):
    """Markup with allowed tags and attributes alone: comments and scripts gone, of attributes only class and href."""
    h = F.regexp_replace(F.col("html"), r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script>", "")
    h = F.regexp_replace(h, r"(?i)</?(?!(?:div|a|b|i|em|note|head)\b)[a-z][^>]*>", "")
    h = F.regexp_replace(h, r"(?i)\s(?!(?:class|href)=)[a-z-]+=\"[^\"]*\"(?=[^<>]*>)", "")
    return _html(s, d).select("doc_id", F.md5(h).alias("h"), F.contains(h, F.lit("onclick")).alias("handlers"), F.contains(h, F.lit('<a href="/w">')).alias("links"))


def linkify(s, d):
    """Words of the glossary made links where they stand as whole words."""
    link = F.regexp_replace("text", r"\b(harbour|portico)\b", '<a href="/glossary/$1">$1</a>')
    return read(s, d, "documents").where("text rlike '\\\\b(harbour|portico)\\\\b'").select("doc_id", F.md5(link).alias("h"))


def json_safe(s, d):
    """Texts as JSON strings that may stand within a script element."""
    t = read(s, d, "documents").where("text is not null").select("doc_id", F.replace(F.replace("text", F.lit("<"), F.lit("\\u003c")), F.lit("&"), F.lit("\\u0026")).alias("t"))
    return t.select("doc_id", F.contains("t", F.lit("<")).alias("open"), F.md5("t").alias("h"))


_CC = "(select distinct {c} from chapter_refs where chapter_id is not null)"
_GG = "(select distinct {c} from gsents where sent_id is not null)"
_HT = "(select doc_id, '<!-- x --><div class=\"a\" onclick=\"b()\"><head>H</head>' || text || '<note>n <b>m</b></note> tail<script>alert(1)</script><a href=\"/w\" title=\"t\">w</a></div>' as html from documents where text is not null)"
_RUN = "(select distinct left(sha256(run), 16) as key from (select unnest(regexp_extract_all(text, '[A-Za-z]{2,}(?:[ ,.]+[A-Za-z]{2,})*')) as run from {src}))"
_KIND = "case " + " ".join(f"when regexp_matches(note, '{p.replace('Ͱ-Ͽἀ-῿', chr(92) + 'x{370}-' + chr(92) + 'x{3FF}' + chr(92) + 'x{1F00}-' + chr(92) + 'x{1FFF}')}') then '{k}'" for k, p in BRACKETS) + " else 'gloss' end"
SQL = {
    "gutter_ticks": f"select chapter_id, \"offset\", arg_min(line, i) as line from (select chapter_id, i, greek_lines[i].citation as line, cast(floor(greek_lines[i].cum_words * len / total) as bigint) as \"offset\" from (select *, unnest(range(1, len(greek_lines) + 1)) as i from (select chapter_id, length(ross_text) as len, greek_lines, greatest(1, list_max(list_transform(greek_lines, lambda x: x.cum_words))) as total from {_CC.format(c='chapter_id, ross_text, greek_lines')} where ross_text <> '' and len(greek_lines) > 1)) where i = 1 or i % 5 = 0) group by chapter_id, \"offset\"",
    "tick_sources": f"select a.line is not null as real, count(*) as n from (select distinct chapter_id, l.citation as line from (select chapter_id, unnest(greek_lines) as l from {_CC.format(c='chapter_id, ref_text, greek_lines')} where ref_text <> '')) l left join (select distinct chapter_id, replace(a.citation, '+', '.') as line from (select chapter_id, unnest(ref_anchors) as a from {_CC.format(c='chapter_id, ref_text, ref_anchors')} where ref_text <> '')) a on a.chapter_id = l.chapter_id and a.line = l.line group by 1",
    "snap_sentence": f"select distinct chapter_id, a.citation as anchor, coalesce(list_min(list_transform(list_filter(ref_sents, lambda x: abs(x.off_start - a.off) <= 12), lambda x: {{'d': abs(x.off_start - a.off), 'o': x.off_start}})).o, a.off) as off from (select chapter_id, ref_sents, unnest(ref_anchors) as a from {_CC.format(c='chapter_id, ref_anchors, ref_sents')})",
    "clamp_anchors": f"select chapter_id, i - 1 as i, max(off) over w as off, max(off) over w > off as moved from (select chapter_id, i, ref_anchors[i].off as off from (select *, unnest(range(1, len(ref_anchors) + 1)) as i from {_CC.format(c='chapter_id, ref_anchors')})) window w as (partition by chapter_id order by i rows unbounded preceding)",
    "anchor_confidence": f"select tier, confidence, count(*) as n from (select tier, case when tier = 'chapter' then 'certain' when off - lag(off) over (partition by chapter_id, len order by i) > 0.05 * len then 'reliable' else 'uncertain' end as confidence from (select chapter_id, len, i, ref_anchors[i].tier as tier, ref_anchors[i].off as off from (select *, length(ref_text) as len, unnest(range(1, len(ref_anchors) + 1)) as i from {_CC.format(c='chapter_id, ref_text, ref_anchors')}))) group by all",
    "explicit_chapters": f"select chapter_id, work_id, book, chapter, greek_lines[1].citation as lo, greek_lines[-1].citation as hi, row_number() over (partition by work_id, book order by chapter_id) = 1 as book_start from {_CC.format(c='chapter_id, work_id, book, chapter, greek_lines')} where work_id is not null and book is not null and len(greek_lines) > 0",
    "compound_lines": f"select sent_id, i - 1 as piece, trim(p[i], ' ') as part from (select sent_id, p, unnest(range(1, len(p) + 1)) as i from (select sent_id, string_split(text, '·') as p from {_GG.format(c='sent_id, text')} where contains(text, '·')))",
    "greek_sentences": f"select sent_id, len(regexp_extract_all(text, '[^.;;]*[\\p{{L}}\\d][^.;;]*')) as sentences, len(regexp_extract_all(text, '[^.;;·]*[\\p{{L}}\\d][^.;;·]*')) as cola from {_GG.format(c='sent_id, lang, text')} where lang = 'grc' and text <> ''",
    "sentence_blocks": f"select distinct sent_id, rtrim(regexp_replace(substring(ross_text, a + 1, coalesce(lead(a) over (partition by chapter_id, ross_text order by a, sent_id), length(ross_text)) - a), '\\s+', ' ', 'g'), ' ') as block from (select chapter_id, ross_text, x.sent_id as sent_id, x.off_start as a from (select chapter_id, ross_text, unnest(ross_sents) as x from {_CC.format(c='chapter_id, ross_text, ross_sents')} where ross_text <> ''))",
    "paragraph_starts": f"select chapter_id, length(array_to_string(p[1:i - 1], '')) as \"at\", length(p[i]) as size from (select chapter_id, p, unnest(range(1, len(p) + 1)) as i from (select chapter_id, string_split(ross_text, chr(10)) as p from {_CC.format(c='chapter_id, ross_text')} where ross_text <> ''))",
    "gap_text": "select doc_id, trim(regexp_replace(regexp_extract(text, '(?s)\\bbecause\\b(.*?)\\bin\\b', 1), '\\s+', ' ', 'g'), ' ') as between from documents where regexp_matches(text, '(?s)\\bbecause\\b(.*?)\\bin\\b')".replace("as between", 'as "between"'),
    "wrap_lines": "select distinct def_id, string_split(w, '-' || chr(10))[1] as head, string_split(w, '-' || chr(10))[2] as tail from (select def_id, unnest(regexp_extract_all(replace(text, chr(13), ''), '([a-z]+-\\n[a-z]+)', 1)) as w from footnote_defs where def_id is not null)",
    "passage_owners": f"select work_id, chapter_id, sum(new) as runs from (select work_id, chapter_id, case when chapter_id = lag(chapter_id) over (partition by work_id order by sent_id) then 0 else 1 end as new from {_GG.format(c='sent_id, work_id, chapter_id')} where work_id is not null and chapter_id is not null) group by all having sum(new) > 1",
    "sigla": "select base, count(*) as n, count(distinct speaker) as spellings from (select speaker, upper(trim(regexp_replace(regexp_replace(regexp_replace(speaker, '(?i)\\(?\\bcont(?:''d|inued)?\\b\\.?\\)?|^\\s*speaker\\s*[—–:-]*', ' ', 'g'), '[^\\p{L}'' ]+', ' ', 'g'), '\\s+', ' ', 'g'))) as base from new_turns where speaker is not null) where base <> '' group by base",
    "mixed_words": f"select w, translate(w, '{FROM_LATIN}', '{TO_GREEK}') as repaired, not regexp_matches(translate(w, '{FROM_LATIN}', '{TO_GREEK}'), '[A-Za-z]') as whole from (select distinct unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{M}}]+')) as w from gsents where sent_id is not null) where regexp_matches(w, '[A-Za-z]') and regexp_matches(w, '[\\x{{370}}-\\x{{3FF}}\\x{{1F00}}-\\x{{1FFF}}]')",
    "edition_notes": f"select {_KIND} as kind, count(*) as n from (select unnest(regexp_extract_all(text, '[(\\[]([^()\\[\\]]*)[)\\]]', 1)) as note from (select distinct frag_id, text from fragments where frag_id is not null) where not regexp_matches(text, '^\\s*[(\\[][^()\\[\\]]*[)\\]]\\s*$')) group by 1",
    "language_decisions": "with u as (select * from {a}), k as (select * from {b}) select key, 'undecided' as problem from u where key not in (from k) union all select key, 'unused' from k where key not in (from u)".replace("{a}", _RUN.replace("{src}", "(select text from gsents where lang = 'grc' and sent_id is not null)")).replace("{b}", _RUN.replace("{src}", "(select text from fragments where regexp_matches(text, '[\\x{370}-\\x{3FF}]'))")),
    "quote_evidence": f"with f as (select distinct frag_id, work_id, w from (select frag_id, work_id, unnest(regexp_extract_all(lower(text), '([a-z'']+)', 1)) as w from fragments where frag_id is not null and work_id is not null) where length(w) >= 6), g as (select distinct work_id, w from (select work_id, unnest(regexp_extract_all(lower(text), '([a-z'']+)', 1)) as w from {_GG.format(c='sent_id, work_id, text')} where work_id is not null) where length(w) >= 6), n as (select frag_id, count(g.w) as agree, sum(case when g.w is null and a.w is not null then 1 else 0 end) as elsewhere from f left join g on g.work_id = f.work_id and g.w = f.w left join (select distinct w from g) a on a.w = f.w group by frag_id) select case when agree >= 3 and agree > elsewhere then 'supported' when elsewhere > agree then 'mismatch' else 'open' end as verdict, count(*) as n from n group by 1",
    "citation_heads": "select distinct def_id, regexp_extract(t, r, 1) as title, cast(regexp_extract(t, r, 2) as bigint) as book, cast(regexp_extract(t, r, 3) as bigint) as number from (select def_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as t from footnote_defs where def_id is not null) where regexp_matches(t, r)".replace("t, r", "t, '^(?:See|Cf\\.) ([^,]+), (\\d+)\\.(\\d+)'"),
    "stub_entries": "select distinct form, lang, lemma from analyses where gloss is null or length(trim(gloss)) < 4",
    "lexicon_coverage": "select distinct lang, regexp_replace(e, '\\d+$', '') as lemma from (select lang, unnest(lsj) as e from analyses) n where not exists (select 1 from analyses a where a.lang = n.lang and a.lemma = regexp_replace(n.e, '\\d+$', ''))",
    "lexicon_missing": f"select lang, w, count(*) as n from (select lang, lower(unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{M}}]+'))) as w from {_GG.format(c='sent_id, lang, text')} where lang is not null) x where not exists (select 1 from analyses a where a.lang = x.lang and lower(a.form) = x.w) group by lang, w having count(*) > 1",
    "author_groups": "select year, lang, count(*) as authors, sum(works) as works from (select author, min(year(released_at)) as year, arg_min(lang, released_at) as lang, count(*) as works from works group by author) group by year, lang",
    "work_groups": 'select work_id, row_number() over (partition by author order by released_at, work_id) as ord, count(*) over (partition by author) as "of" from works',
    "manifests": f"select work_id, cast(to_json({{'work_id': work_id, 'title': title, 'lang': lang, 'scheme': scheme, 'n_books': n_books, 'chapters': coalesce(chapters, 0), 'corpus_version': corpus_version}}) as varchar) as manifest from works left join (select work_id, count(*) as chapters from {_CC.format(c='chapter_id, work_id')} where work_id is not null group by work_id) using (work_id)",
    "heading_at": f"select d.doc_id, arg_max(c.chapter_id, c.\"at\") as chapter_id from (select doc_id, work_id, cast(locus as bigint) as \"at\" from documents where work_id is not null and regexp_matches(locus, '^[0-9]{{1,9}}$')) d left join (select work_id, cast(citation as bigint) as \"at\", min(chapter_id) as chapter_id from {_CC.format(c='chapter_id, work_id, citation')} where work_id is not null and regexp_matches(citation, '^[0-9]{{1,9}}$') group by 1, 2) c on c.work_id = d.work_id and c.\"at\" <= d.\"at\" group by d.doc_id",
    "book_headings": f"select work_id, book, arg_min(citation, chapter_id) filter (where citation is not null) as heading, count(distinct chapter_id) as chapters from {_CC.format(c='chapter_id, work_id, book, citation')} where work_id is not null and book is not null group by all",
    "orphans": f"select 'chapter' as level, count(*) as n from {_CC.format(c='chapter_id, work_id')} where work_id not in (select work_id from works) union all select 'sentence', count(*) from {_GG.format(c='sent_id, chapter_id')} where chapter_id not in (select chapter_id from chapter_refs where chapter_id is not null) union all select 'document', count(*) from documents where work_id not in (select work_id from works) union all select 'unshelved', count(*) from works where work_id not in (select work_id from chapter_refs where work_id is not null and chapter_id is not null)",
    "path_stops": "select scheme, arg_min(work_id, work_id) as first_stop, count(*) as n, array_to_string(list_sort(list(work_id))[1:3], ',') as shown from works where work_id in (select work_id from chapter_refs where chapter_id is not null) group by scheme",
    "held_works": " union all ".join(f"select '{t}' as tbl, count(*) as n from {t} where work_id in (select work_id from works where corpus_version is null)" for t in ("documents", "chapter_refs", "fragments")),
    "stable_bytes": "select work_id, count(*) as n, cast(sum(cast('0x' || left(md5(text), 8) as bigint)) as bigint) as total, left(md5(min(md5(text)) || max(md5(text))), 8) as ends from documents where work_id is not null and text is not null group by work_id",
    "drop_subtrees": f"select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<note\\b[^>]*>.*?</note>|<head\\b[^>]*>.*?</head>|<script\\b[^>]*>.*?</script>', '', 'g'), '(?s)</?[A-Za-z][^>]*>', ' ', 'g'), '\\s+', ' ', 'g'), ' ') as text from {_HT}",
    "linkify": "select doc_id, md5(regexp_replace(text, '\\b(harbour|portico)\\b', '<a href=\"/glossary/\\1\">\\1</a>', 'g')) as h from documents where regexp_matches(text, '\\b(harbour|portico)\\b')",
    "json_safe": "select doc_id, false as open, md5(replace(replace(text, '<', '\\u003c'), '&', '\\u0026')) as h from documents where text is not null",
}
QUERIES = {f.__name__: f for f in (gutter_ticks, tick_sources, snap_sentence, clamp_anchors, anchor_confidence, explicit_chapters, compound_lines, greek_sentences, sentence_blocks, paragraph_starts, gap_text, wrap_lines, passage_owners, sigla, mixed_words, edition_notes, language_decisions, quote_evidence, citation_heads, stub_entries, lexicon_coverage, lexicon_missing, author_groups, work_groups, manifests, heading_at, book_headings, orphans, path_stops, held_works, stable_bytes, drop_subtrees, safe_markup, linkify, json_safe)}
