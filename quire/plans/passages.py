"""Passages: references that go on from note to note, witnesses, slices, openings, and words in their context."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import index, stats
from quire.plans.keys import SQL as KEYS_SQL
from quire.plans.keys import token_walk
from quire.plans.originals import _LP, _forms, _lemmata
from quire.plans.text import POSTINGS
from quire.sources.tables import read

OPENINGS = (8, 6, 5, 4)
#: Bits, a megabyte in all, that tell every task which words chapters may open with; more openings make it a weaker filter, no other result.
OPENING_BITS = 1 << 23
OPENING_PARTS = 8


def _c(s, d, *cols):
    return read(s, d, "chapter_refs").where("chapter_id is not null").select("chapter_id", *cols).distinct()


def inherited_refs(s, d):
    """Places that notes name without a work: they go on with the work that the last note before them named."""
    n = read(s, d, "footnote_defs").where("def_id is not null and work_id is not null and text is not null").select("def_id", "work_id", T.collapse(F.col("text")).alias("t")).distinct()
    full, bare = r"^(?:See|Cf\.) ([^,0-9]+), (\d+\.\d+)", r"^(?:See|Cf\.) (\d+\.\d+)"
    n = n.withColumn("title", F.nullif(F.regexp_extract("t", full, 1), F.lit(""))).withColumn("place", F.nullif(F.regexp_extract("t", bare, 1), F.lit("")))
    last = F.last("title", ignorenulls=True).over(Window.partitionBy("work_id").orderBy("def_id", "t").rowsBetween(Window.unboundedPreceding, 0))
    return n.withColumn("from", last).where("place is not null").select("def_id", "place", F.col("from").alias("title")).distinct()


def witnesses(s, d):
    """Witnesses of one fragment, numbered in order; a place with one alone is none."""
    f = read(s, d, "fragments").where("frag_id is not null and source_file is not null and column_key is not null and text <> ''").select("frag_id", "source_file", "column_key", "text").distinct()
    w = Window.partitionBy("source_file", "column_key")
    f = f.withColumn("of", F.count(F.lit(1)).over(w)).withColumn("no", F.row_number().over(w.orderBy("frag_id", "text")))
    return f.where("of > 1").select("frag_id", F.col("no").cast("long").alias("no"), "of")


def cell_tokens(s, d):
    """Tokens by the comma-parted cell of their sentence, with offsets from the cell's start."""
    g = read(s, d, "gsents").where("sent_id is not null and contains(text, ',')").select("sent_id", "text").distinct()
    t = token_walk(s, d).join(g, "sent_id").withColumn("before", F.expr("substring(text, 1, offset)"))
    cell = F.length(F.regexp_replace("before", "[^,]", ""))
    start = F.length(F.regexp_extract("before", r"(?s)^(.*,)", 1))
    return t.select("sent_id", "pos", cell.cast("long").alias("cell"), (F.col("offset") - start).alias("at"))


def damaged_scraps(s, d):
    """Words of one or two letters without any mark in fragments: scraps that get no key, by work."""
    w = read(s, d, "fragments").where("frag_id is not null and work_id is not null").select("frag_id", "work_id", F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{M}]+"), F.lit(0))).alias("w")).where("w rlike '^[α-ως]{1,2}$'")
    return w.groupBy("work_id", "w").agg(F.countDistinct("frag_id").alias("n"))


def line_accuracy(s, d):
    """How well lines placed by their share of the text meet the anchors: exact and one off, by language and tier."""
    c = _c(s, d, "ref_lang", "ref_text", "ref_anchors", "greek_lines").where("ref_text <> '' and size(greek_lines) > 0")
    a = c.select("ref_lang", F.length("ref_text").alias("len"), F.size("greek_lines").alias("n"), F.explode("ref_anchors").alias("a")).where(r"a.citation rlike '\\+\\d+$'")
    true = F.regexp_extract("a.citation", r"\+(\d+)$", 1).cast("long")
    got = F.floor(F.col("a.off") * F.col("n") / F.col("len")) + 1
    off = F.abs(got - true)
    return a.groupBy("ref_lang", F.col("a.tier").alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((off == 0).cast("double")), 4).alias("exact"), F.round(F.avg((off <= 1).cast("double")), 4).alias("off_by_one"))


def line_slices(s, d):
    """Translations cut over the lines of the original by their share of the words, cuts moved on to the next space."""
    c = _c(s, d, "ross_text", "greek_lines").where("ross_text <> '' and size(greek_lines) > 1")
    total = F.greatest(F.lit(1), F.element_at("greek_lines", -1)["cum_words"])
    t = c.select("chapter_id", "ross_text", total.alias("total"), F.explode("greek_lines").alias("l")).select("chapter_id", "ross_text", F.col("l.citation").alias("line"), F.floor(F.length("ross_text") * F.col("l.cum_words") / F.col("total")).cast("int").alias("raw"))
    rest = F.expr("substring(ross_text, raw + 1)")
    start = F.when(F.col("raw") == 0, 0).when(F.instr(rest, " ") == 0, F.length("ross_text")).otherwise(F.col("raw") + F.instr(rest, " "))
    t = t.select("chapter_id", "ross_text", "line", start.alias("a"))
    end = F.coalesce(F.lead("a").over(Window.partitionBy("chapter_id", F.md5("ross_text")).orderBy("a", "line")), F.length("ross_text"))
    return t.withColumn("b", end).select("chapter_id", "line", F.col("a").cast("long").alias("start"), F.col("b").cast("long").alias("end"))


def _seen(heads: DataFrame) -> DataFrame:
    """One row: a bit for each hash of ``g`` that occurs, of OPENING_BITS in all, in words of 64."""
    at = heads.select(F.pmod(F.xxhash64("g"), F.lit(OPENING_BITS)).alias("at"))
    found = at.groupBy(F.shiftright("at", 6).alias("i")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("b"))
    found = heads.sparkSession.range(OPENING_BITS // 64).withColumnRenamed("id", "i").join(found.hint("merge"), "i", "left")
    return found.agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("b", F.lit(0).cast("long")).alias("b")))).alias("x")).select(F.transform("x", lambda x: x["b"]).alias("bits"))


def chapter_openings(s, d):
    """Documents in which a chapter's translation opens: by the longest of several openings that stands there.

    Each opening holds the shortest, so that places are joined by this alone, and what
    follows there tells how far they agree. A table of bits of a fixed size passes over the
    places where no chapter opens before anything moves; a chapter with one text needs no
    aggregate of its pairs, which may be many more than either table's rows.
    """
    least, most = min(OPENINGS), max(OPENINGS)
    c = _c(s, d, "ross_text").select("chapter_id", T.words(F.col("ross_text")).alias("w")).where(f"size(w) >= {most}")
    heads = c.select("chapter_id", F.array_join(F.slice("w", 1, most), " ").alias("h")).distinct()
    heads = heads.withColumn("g", F.substring_index("h", " ", least)).withColumn("texts", F.count(F.lit(1)).over(Window.partitionBy("chapter_id")))
    docs = read(s, d, "documents").where("text is not null").select("doc_id", T.words(F.col("text")).alias("w"))
    places = F.transform(F.slice("w", F.lit(1), F.greatest(F.lit(0), F.size("w") - (least - 1))), lambda _, i: F.array_join(F.slice("w", i + 1, F.lit(most)), " "))
    tall = docs.select("doc_id", F.explode(F.array_distinct(places)).alias("p")).withColumn("g", F.substring_index("p", " ", least))
    at = F.pmod(F.xxhash64("g"), F.lit(OPENING_BITS))
    bit = F.expr("shiftright(element_at(bits, cast(shiftright(at, 6) as int) + 1), cast(at & 63 as int)) & 1 = 1")
    tall = tall.withColumn("at", at).join(F.broadcast(_seen(heads.select("g"))), bit, "left_semi")
    # A common opening's documents are parted over several tasks, each with all its chapters.
    tall = tall.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(OPENING_PARTS)))
    heads = heads.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(OPENING_PARTS - 1).cast("long"))))
    longer = sorted(OPENINGS)[1:]
    sets = [F.collect_set(F.substring_index("p", " ", n)).alias(f"p{n}") for n in longer]
    found = tall.repartition("g", "part").groupBy("g", "part", "doc_id").agg(*sets)
    words = F.lit(least)
    for n in longer:
        words = F.when(F.array_contains(f"p{n}", F.substring_index("h", " ", n)), n).otherwise(words)
    pairs = [found.join(heads.where(x).hint("merge"), ["g", "part"]).select("chapter_id", "doc_id", words.cast("long").alias("words")) for x in ("texts = 1", "texts > 1")]
    return pairs[0].unionByName(pairs[1].groupBy("chapter_id", "doc_id").agg(F.max("words").alias("words")))


def paragraph_flow(s, d):
    """Paragraphs of translations brought to sentences: to the start of the one that they break, or past its middle to the next."""
    c = _c(s, d, "ross_text", "ross_sents").where("ross_text <> '' and size(ross_sents) > 0")
    p = c.select("chapter_id", "ross_sents", F.length("ross_text").alias("len"), F.split("ross_text", "\n").alias("p")).select("chapter_id", "ross_sents", "len", "p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("i")).where("i > 1")
    at = F.length(F.array_join(F.slice("p", F.lit(1), F.col("i") - 1), "\n")) + 1
    p = p.select("chapter_id", "ross_sents", "len", at.alias("at"))
    start = F.array_max(F.transform(F.filter("ross_sents", lambda x: x["off_start"] <= F.col("at")), lambda x: x["off_start"]))
    nxt = F.array_min(F.transform(F.filter("ross_sents", lambda x: x["off_start"] > F.col("at")), lambda x: x["off_start"]))
    p = p.withColumn("a", F.coalesce(start, F.lit(0))).withColumn("b", F.coalesce(nxt, F.col("len")))
    to = F.when((F.col("at") - F.col("a")) * 2 > F.col("b") - F.col("a"), F.col("b")).otherwise(F.col("a"))
    return p.select("chapter_id", F.col("at").cast("long").alias("at"), to.cast("long").alias("to")).distinct()


def kwic_everywhere(s, d):
    """Every place of a word with 140 characters on each side, cut back to whole words."""
    docs = read(s, d, "documents").where("contains(text, 'portico')").select("doc_id", "text", F.split("text", "portico").alias("p"))
    t = docs.select("doc_id", "text", "p", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("i"))
    at = F.length(F.array_join(F.slice("p", F.lit(1), F.col("i")), "portico"))
    t = t.select("doc_id", "text", at.alias("at"))
    left = F.expr("substring(text, greatest(at - 140, 0) + 1, at - greatest(at - 140, 0))")
    right = F.expr("substring(text, at + 8, 140)")
    left = F.when(F.col("at") > 140, F.regexp_replace(left, r"^[^ ]* ", "")).otherwise(left)
    right = F.when(F.length("text") > F.col("at") + 147, F.regexp_replace(right, r" [^ ]*$", "")).otherwise(right)
    return t.select("doc_id", F.col("at").cast("long").alias("at"), left.alias("left"), right.alias("right"))


def char_samples(s, d):
    """Characters outside the usual set: how many documents hold each, and the first five."""
    ch = read(s, d, "documents").where("text is not null").select("doc_id", F.explode(F.array_distinct(F.split("text", ""))).alias("ch")).where(r"ch rlike '^[^\\p{L}\\p{N} .,;:!?\\n\\r-]$'")
    n = ch.groupBy("ch").agg(F.count(F.lit(1)).alias("n"))
    five = stats.top_k(ch, ["ch"], [F.col("doc_id")], 5).groupBy("ch").agg(F.array_join(F.array_sort(F.collect_list("doc_id")), ",").alias("first_docs"))
    return n.join(five, "ch").select(F.ascii("ch").cast("long").alias("code"), "n", "first_docs")


def decoded_paths(s, d):
    """Paths decoded once: those with dot segments, backslashes or control signs, or too long, are refused."""
    w = read(s, d, "works").select("work_id")
    tails = ["book-01.json", "%2e%2e/secret", "a%5Cb", "x%00y", "a/./b", "%252e%252e/x", "ok%20name.json", "n" * 520]
    p = w.select(F.explode(F.array(*[F.concat(F.lit("/data/"), "work_id", F.lit("/" + t)) for t in tails])).alias("path")).withColumn("plain", F.try_url_decode("path"))
    bad = F.col("plain").isNull() | F.col("plain").rlike(r"(?:^|/)\.{1,2}(?:/|$)|\\|[\x00-\x1f]") | (F.length("path") > 512)
    return p.groupBy((~bad).alias("safe")).agg(F.count(F.lit(1)).alias("n"))


def search_star(s, d):
    """A star alone asks for every segment that has a word."""
    return index.postings(read(s, d, "documents"), "doc_id", "text").select("seg").distinct()


def lemma_browse(s, d):
    """Headwords of the originals that stand three times or more: how often, in how many works, their first sentence, and their glosses."""
    f = _forms(s, d).join(F.broadcast(_lemmata(s, d)), ["lang", "key"])
    n = f.groupBy("lang", "head").agg(F.countDistinct("seg", "pos").alias("n"), F.countDistinct("work_id").alias("works"), F.min("seg").alias("first_sent")).where("n >= 3")
    key = F.translate(T.strip_accents(F.lower("lemma")), "ς", "σ")
    g = read(s, d, "analyses").where("gloss is not null").groupBy("lang", key.alias("head")).agg(F.array_join(F.slice(F.array_sort(F.collect_set("gloss")), 1, 5), " | ").alias("glosses"))
    return n.join(F.broadcast(g), ["lang", "head"], "left")


def sense_depth(s, d):
    """Depth of each part's size within its brand: dense ranks, five at most."""
    p = read(s, d, "part").select("p_brand", "p_size").distinct()
    return p.select("p_brand", F.col("p_size").cast("long").alias("p_size"), F.least(F.lit(5), F.dense_rank().over(Window.partitionBy("p_brand").orderBy("p_size"))).cast("long").alias("depth"))


_CC = "(select distinct {c} from chapter_refs where chapter_id is not null)"
_WORDS = "regexp_extract_all(lower({x}), '([a-z'']+)', 1)"
SQL = {
    "inherited_refs": "with n as (select distinct def_id, work_id, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') as t from footnote_defs where def_id is not null and work_id is not null and text is not null), h as (select *, nullif(regexp_extract(t, '^(?:See|Cf\\.) ([^,0-9]+), (\\d+\\.\\d+)', 1), '') as own, nullif(regexp_extract(t, '^(?:See|Cf\\.) (\\d+\\.\\d+)', 1), '') as place from n) select distinct def_id, place, title from (select *, last_value(own ignore nulls) over (partition by work_id order by def_id, t rows unbounded preceding) as title from h) where place is not null",
    "witnesses": "select frag_id, no, \"of\" from (select frag_id, row_number() over (partition by source_file, column_key order by frag_id, text) as no, count(*) over (partition by source_file, column_key) as \"of\" from (select distinct frag_id, source_file, column_key, text from fragments where frag_id is not null and source_file is not null and column_key is not null and text <> '')) where \"of\" > 1",
    "cell_tokens": f"select sent_id, pos, length(regexp_replace(b, '[^,]', '', 'g')) as cell, o - length(regexp_extract(b, '(?s)^(.*,)', 1)) as \"at\" from (select sent_id, pos, t.\"offset\" as o, substring(text, 1, t.\"offset\") as b from ({KEYS_SQL['token_walk']}) t join (select distinct sent_id, text from gsents where sent_id is not null and contains(text, ',')) g using (sent_id))",
    "damaged_scraps": "select work_id, w, count(distinct frag_id) as n from (select frag_id, work_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{M}]+')) as w from fragments where frag_id is not null and work_id is not null) where regexp_matches(w, '^[α-ως]{1,2}$') group by work_id, w",
    "line_accuracy": f"select ref_lang, tier, count(*) as n, round(avg(case when d = 0 then 1.0 else 0.0 end), 4) as exact, round(avg(case when d <= 1 then 1.0 else 0.0 end), 4) as off_by_one from (select ref_lang, a.tier as tier, abs(floor(a.off * n / len) + 1 - cast(regexp_extract(a.citation, '\\+(\\d+)$', 1) as bigint)) as d from (select ref_lang, length(ref_text) as len, len(greek_lines) as n, unnest(ref_anchors) as a from {_CC.format(c='chapter_id, ref_lang, ref_text, ref_anchors, greek_lines')} where ref_text <> '' and len(greek_lines) > 0) where regexp_matches(a.citation, '\\+\\d+$')) group by all",
    "line_slices": f"select chapter_id, line, a as start, coalesce(lead(a) over (partition by chapter_id, ross_text order by a, line), length(ross_text)) as \"end\" from (select chapter_id, ross_text, line, case when raw = 0 then 0 when position(' ' in substring(ross_text, raw + 1)) = 0 then length(ross_text) else raw + position(' ' in substring(ross_text, raw + 1)) end as a from (select chapter_id, ross_text, l.citation as line, cast(floor(length(ross_text) * l.cum_words / total) as bigint) as raw from (select chapter_id, ross_text, greatest(1, greek_lines[-1].cum_words) as total, unnest(greek_lines) as l from {_CC.format(c='chapter_id, ross_text, greek_lines')} where ross_text <> '' and len(greek_lines) > 1)))",
    "chapter_openings": f"with h as (select distinct chapter_id, n, array_to_string(w[1:n], ' ') as g from (select chapter_id, w, unnest([8, 6, 5, 4]) as n from (select chapter_id, {_WORDS.format(x='ross_text')} as w from {_CC.format(c='chapter_id, ross_text')}) where len(w) >= 8)), d as (select doc_id, ' ' || array_to_string({_WORDS.format(x='text')}, ' ') || ' ' as b from documents where text is not null) select chapter_id, doc_id, max(n) as words from h join d on contains(b, ' ' || g || ' ') group by all",
    "paragraph_flow": f"select distinct chapter_id, at_ as \"at\", case when (at_ - a) * 2 > b - a then b else a end as \"to\" from (select chapter_id, at_, coalesce(list_max(list_transform(list_filter(ross_sents, lambda x: x.off_start <= at_), lambda x: x.off_start)), 0) as a, coalesce(list_min(list_transform(list_filter(ross_sents, lambda x: x.off_start > at_), lambda x: x.off_start)), len) as b from (select chapter_id, ross_sents, len, length(array_to_string(p[1:i - 1], chr(10))) + 1 as at_ from (select chapter_id, ross_sents, length(ross_text) as len, p, unnest(range(1, len(p) + 1)) as i from (select *, string_split(ross_text, chr(10)) as p from {_CC.format(c='chapter_id, ross_text, ross_sents')} where ross_text <> '' and len(ross_sents) > 0)) where i > 1))",
    "kwic_everywhere": "select doc_id, at_ as \"at\", case when at_ > 140 then regexp_replace(l, '^[^ ]* ', '') else l end as \"left\", case when length(text) > at_ + 147 then regexp_replace(r, ' [^ ]*$', '') else r end as \"right\" from (select doc_id, text, at_, substring(text, greatest(at_ - 140, 0) + 1, at_ - greatest(at_ - 140, 0)) as l, substring(text, at_ + 8, 140) as r from (select doc_id, text, length(array_to_string(p[1:i], 'portico')) as at_ from (select doc_id, text, p, unnest(range(1, len(p))) as i from (select doc_id, text, string_split(text, 'portico') as p from documents where contains(text, 'portico')))))",
    "char_samples": "with c as (select doc_id, unnest(list_distinct(string_split(text, ''))) as ch from documents where text is not null), k as (select *, row_number() over (partition by ch order by doc_id) as r from c where regexp_matches(ch, '^[^\\p{L}\\p{N} .,;:!?\\n\\r-]$')) select unicode(ch) as code, count(*) as n, string_agg(cast(doc_id as varchar), ',' order by doc_id) filter (where r <= 5) as first_docs from k group by ch",
    "search_star": f"select distinct seg from {POSTINGS}",
    "lemma_browse": f"select n.lang, n.head, n, works, first_sent, glosses from (select f.lang, l.head, count(distinct (seg, pos)) as n, count(distinct work_id) as works, min(seg) as first_sent from {_LP} f join (select distinct lang, head from analyses a, (select translate(strip_accents(lower(lemma)), 'ς', 'σ') as head) where lang in ('grc', 'lat') and lemma is not null and form is not null) l on l.lang = f.lang and l.head = f.head and f.key in (select translate(strip_accents(lower(form)), 'ς', 'σ') from analyses b where b.lang = f.lang) group by f.lang, l.head having count(distinct (seg, pos)) >= 3) n left join (select lang, translate(strip_accents(lower(lemma)), 'ς', 'σ') as head, array_to_string(list_sort(list(distinct gloss))[1:5], ' | ') as glosses from analyses where gloss is not null group by 1, 2) g on g.lang = n.lang and g.head = n.head",
    "sense_depth": "select p_brand, p_size, least(5, dense_rank() over (partition by p_brand order by p_size)) as depth from (select distinct p_brand, p_size from part)",
}
QUERIES = {f.__name__: f for f in (inherited_refs, witnesses, cell_tokens, damaged_scraps, line_accuracy, line_slices, chapter_openings, paragraph_flow, kwic_everywhere, char_samples, decoded_paths, search_star, lemma_browse, sense_depth)}
