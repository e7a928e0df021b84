"""Citations, markup, quality checks and alignments over the domain tables."""

from __future__ import annotations

from pyspark.sql import Window
from functools import reduce

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import align, cite, index, markup, quality, stats
from quire.plans.models import _KIND, BRACKETS
from quire.sources.tables import read


def cite_scheme(s, d):
    c = read(s, d, "chapter_refs").where("citation is not null").select("chapter_id", "citation").distinct()
    k = cite.sort_key(F.col("citation"))
    return c.select("chapter_id", cite.scheme(F.col("citation")).alias("scheme"), k["a"].alias("a"), k["n"].alias("n"))


def cite_resolve(s, d):
    p = read(s, d, "chapter_refs").where("citation is not null").select("work_id", "citation").distinct()
    q = p.groupBy("citation").agg(F.min("work_id").alias("context")).select(F.col("citation").alias("query"), "context")
    return cite.resolve(q, p).withColumn("stage", F.col("stage").cast("long"))


def cite_mentions(s, d):
    """Pages that notes refer to, with how often."""
    m = F.explode(F.regexp_extract_all("text", F.lit(r"\bp\. ?([0-9]+)"), F.lit(1)))
    return read(s, d, "footnote_defs").select("def_id", "text").distinct().select(m.alias("page")).groupBy(F.col("page").cast("long").alias("page")).agg(F.count(F.lit(1)).alias("n"))


def column_enumeration(s, d):
    """Every page side from 1a to 60e."""
    pages = s.range(1, 61).select(F.col("id").alias("page"))
    return pages.select("page", F.explode(F.array(*map(F.lit, "abcde"))).alias("side")).select(F.concat(F.col("page"), F.col("side")).alias("column"), (F.col("page") * 10 + F.ascii("side") - 96).alias("position"))


def section_outline(s, d):
    """First chapter of each book of each work, and how many there are."""
    c = read(s, d, "chapter_refs").select("work_id", "book", "chapter_id", "citation").distinct()
    return c.groupBy("work_id", "book").agg(F.min("chapter_id").alias("first_chapter"), F.count(F.lit(1)).alias("chapters")).select("work_id", F.col("book").cast("long").alias("book"), "first_chapter", "chapters")


def html_plain(s, d):
    return read(s, d, "documents").where("text is not null").select("doc_id", markup.plain(F.col("text")).alias("plain"))


def link_list(s, d):
    return read(s, d, "documents").select("doc_id", F.explode(markup.links(F.col("text"))).alias("link")).groupBy("link").agg(F.countDistinct("doc_id").alias("docs"))


def html_safe(s, d):
    return read(s, d, "documents").where("text is not null").select("doc_id", T.escape_html(F.col("text")).alias("safe"))


def highlight(s, d):
    return read(s, d, "documents").where("contains(lower(text), 'harb')").select("doc_id", markup.highlight(F.col("text"), "harb").alias("marked"))


def checks_domain(s, d):
    g, c = read(s, d, "gsents"), read(s, d, "chapter_refs")
    spans = g.where("span_start is not null and span_end is not null and text is not null")
    return quality.suite([
        quality.problems(spans, "span length", F.col("span_end") - F.col("span_start") != F.length("text"), F.col("sent_id")),
        quality.problems(g, "empty text", F.coalesce(F.trim("text"), F.lit("")) == "", F.col("sent_id")),
        quality.duplicates(g, ["sent_id"], "resent sentence"),
        quality.missing(g, "chapter_id", c, "chapter_id", "chapter unknown"),
        quality.missing(read(s, d, "documents"), "work_id", read(s, d, "works"), "work_id", "work unknown"),
        quality.problems(read(s, d, "documents"), "length", F.col("n_chars") != F.length("text"), F.col("doc_id")),
        quality.missing(read(s, d, "new_turns"), "dialogue_id", read(s, d, "speakers"), "dialogue_id", "no roster"),
    ])


def span_gaps(s, d):
    """Sentences that do not begin one place after their neighbour's end."""
    g = read(s, d, "gsents").select("chapter_id", "sent_id", "seq", "span_start", "span_end").distinct()
    w = Window.partitionBy("chapter_id").orderBy("seq", "sent_id")
    return g.withColumn("before", F.lag("span_end").over(w)).where("span_start <> before + 1").select("chapter_id", "sent_id")


def run_classify(s, d):
    """Language of a document by a vote of function words: those among the forty most frequent of one language's documents alone."""
    docs = read(s, d, "documents").withColumn("declared", F.col("lang")).select("doc_id", "declared", "text")
    w = index.postings(docs, "doc_id", "text", ["declared"])
    n = w.where("declared is not null").groupBy("declared", "term").agg(F.count(F.lit(1)).alias("n"))
    top = stats.top_k(n, ["declared"], [F.col("n").desc(), F.col("term")], 40)
    own = top.groupBy("term").agg(F.count(F.lit(1)).alias("k"), F.min("declared").alias("lang")).where("k = 1")
    n = w.join(F.broadcast(own.select("term", "lang")), "term").groupBy("seg", "lang").agg(F.count(F.lit(1)).alias("n"))
    return stats.top_k(n, ["seg"], [F.col("n").desc(), F.col("lang")], 1).select("seg", "lang", "n")


def bracket_classify(s, d):
    """Kinds of bracketed notes in originals and documents, by the first rule that fits: cross-reference, date, mark, note, Greek, gloss."""
    texts = read(s, d, "gsents").select("sent_id", "text").distinct().select("text").unionByName(read(s, d, "documents").select("text"))
    b = texts.select(F.explode(F.regexp_extract_all("text", F.lit(r"[(\[]([^()\[\]]*)[)\]]"), F.lit(1))).alias("note"))
    kind = reduce(lambda acc, kp: acc.when(F.col("note").rlike(kp[1]), kp[0]), BRACKETS, F.when(F.lit(False), ""))
    return b.groupBy(kind.otherwise("gloss").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def probe_hits(s, d):
    """Documents that share an eight-word run with another document: probes by hash, hits by equi-join."""
    w = read(s, d, "documents").select("doc_id", T.words(F.col("text")).alias("w")).where("size(w) >= 8")
    p = w.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - 8), lambda i: F.xxhash64(F.array_join(F.slice("w", i + 1, 8), " ")))).alias("h")).distinct()
    hot = p.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    return p.join(hot.where("n > 1"), "h").groupBy("doc_id").agg(F.count(F.lit(1)).alias("shared"))


def _streams(s, d):
    a = read(s, d, "new_turns").select("line_id", "dialogue_id", "line_no", "speaker", "text").distinct()
    b = read(s, d, "ref_turns").select("ref_id", "dialogue_id", "turn_index", "speaker", "text").distinct()
    label = F.lower(F.regexp_extract("speaker", r"([A-Za-z]+)\W*$", 1)).alias("label")
    return a.select("dialogue_id", F.col("line_no").cast("long").alias("ord"), label, "text"), b.select("dialogue_id", F.col("turn_index").cast("long").alias("ord"), label, "text")


def pair_turns_lcs(s, d):
    return align.align_groups(*_streams(s, d), "dialogue_id", "lcs")


def align_turns_nw(s, d):
    return align.align_groups(*_streams(s, d), "dialogue_id", "global")


def pair_turns_filled(s, d):
    """Anchors by label, and what lies between them."""
    return align.align_groups(*_streams(s, d), "dialogue_id", "filled")


def align_turns_zipped(s, d):
    """Turns aligned by likeness, with those of one speaker left between two pairs."""
    return align.align_groups(*_streams(s, d), "dialogue_id", "zipped")


def chapter_margins(s, d):
    """Anchors of a chapter to the sentence of its translation most like what follows them, in order: how sure each is.

    Chapters' own anchors are certain, others reliable if their margin is above 0.05;
    each anchor's offset never falls behind the one before it.
    """
    c = read(s, d, "chapter_refs").where("chapter_id is not null and ross_text <> '' and ref_text <> ''").select("chapter_id", "ross_text", "ross_sents", "ref_text", "ref_anchors").distinct()

    def run(batches):
        import pandas as pd

        for b in batches:
            out = []
            for k, text, sents, ref, anchors in zip(b["chapter_id"], b["ross_text"], b["ross_sents"], b["ref_text"], b["ref_anchors"]):
                sents = sorted((x["off_start"], x["off_end"]) for x in (sents if sents is not None else ()))
                anchors = sorted((x["off"], x["citation"], x["tier"]) for x in (anchors if anchors is not None else ()))
                if not sents or not anchors:
                    continue
                ends = [a[0] for a in anchors[1:]] + [len(ref)]
                m = align.similarity([ref[a[0] : e] for a, e in zip(anchors, ends)], [text[x:y] for x, y in sents])
                path = align.monotone(m)
                for (_, cite_, tier), j, margin in zip(anchors, path, align.margins(m, path)):
                    sure = "certain" if tier == "chapter" else "reliable" if margin > 0.05 else "uncertain"
                    out.append((k, cite_, 0 if tier == "chapter" else sents[j][0], sure))
            yield pd.DataFrame(out, columns=["chapter_id", "citation", "off", "confidence"])

    return c.mapInPandas(run, "chapter_id long, citation string, off long, confidence string")


def align_monotone(s, d):
    return align.align_groups(*_streams(s, d), "dialogue_id", "monotone")


def bead_align(s, d):
    return align.align_groups(*_streams(s, d), "dialogue_id", "beads")


def page_blocks(s, d):
    g = read(s, d, "gsents").where("work_id is not null").groupBy("work_id", "chapter_id").agg(F.countDistinct("sent_id").alias("n"))
    return align.pages(g, "work_id", "chapter_id", "n", 40)


_W = r"regexp_extract_all(lower(text), '([a-z'']+)', 1)"
_ESC = "replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_UNESC = "replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&nbsp;', ' '), '&amp;', '&')"
SQL = {
    "cite_scheme": r"""with c as (select distinct chapter_id, citation as x from chapter_refs where citation is not null)
        select chapter_id, case when regexp_matches(x, '^(\d+)([a-e])(?:\.?(\d+))?$') then 'page_column' when regexp_matches(x, '^(\d+)\.(\d+)(?:\.(\d+))?$') then 'book_number' when regexp_matches(x, '^([AB])\s?(\d+)(?:\.(\d+))?$') then 'fragment' when regexp_matches(x, '^(\d+)$') then 'number' end as scheme,
        case when regexp_matches(x, '^(\d+)([a-e])(?:\.?(\d+))?$') or regexp_matches(x, '^(\d+)\.(\d+)(?:\.(\d+))?$') or regexp_matches(x, '^(\d+)$') then cast(regexp_extract(x, '^(\d+)', 1) as bigint) when regexp_matches(x, '^([AB])\s?(\d+)(?:\.(\d+))?$') then cast(regexp_extract(x, '^[AB]\s?(\d+)', 1) as bigint) end as a,
        case when regexp_matches(x, '^(\d+)([a-e])(?:\.?(\d+))?$') then coalesce(cast(nullif(regexp_extract(x, '^(\d+)([a-e])(?:\.?(\d+))?$', 3), '') as bigint), 0) when regexp_matches(x, '^(\d+)\.(\d+)(?:\.(\d+))?$') then coalesce(cast(nullif(regexp_extract(x, '^(\d+)\.(\d+)(?:\.(\d+))?$', 3), '') as bigint), 0) when regexp_matches(x, '^([AB])\s?(\d+)(?:\.(\d+))?$') then coalesce(cast(nullif(regexp_extract(x, '^([AB])\s?(\d+)(?:\.(\d+))?$', 3), '') as bigint), 0) else 0 end as n from c""",
    "cite_resolve": r"""with p as (select distinct work_id, citation, regexp_extract(citation, '^(\d+)', 1) as num from chapter_refs where citation is not null), q as (select citation as query, min(work_id) as context, any_value(num) as num from p group by citation),
        h as (select query, case when work_id = context then 1 else 2 end as stage, work_id from q join p on query = citation union all select query, 3, work_id from q join p on q.num = p.num where q.num <> ''), b as (select query, min(stage) as stage from h group by query)
        select query, cast(stage as bigint) as stage, string_agg(distinct work_id, ',' order by work_id) as candidates, count(distinct work_id) > 1 as ambiguous from h join b using (query, stage) group by query, stage""",
    "cite_mentions": r"select cast(page as bigint) as page, count(*) as n from (select unnest(regexp_extract_all(text, '\bp\. ?([0-9]+)', 1)) as page from (select distinct def_id, text from footnote_defs)) group by 1",
    "column_enumeration": "select page || side as \"column\", page * 10 + ascii(side) - 96 as position from (select unnest(generate_series(1, 60)) as page), (select unnest(['a', 'b', 'c', 'd', 'e']) as side)",
    "section_outline": "select work_id, cast(book as bigint) as book, min(chapter_id) as first_chapter, count(*) as chapters from (select distinct work_id, book, chapter_id, citation from chapter_refs) group by work_id, book",
    "html_plain": r"select doc_id, regexp_replace(regexp_replace({}, '\s+', ' ', 'g'), '^ +| +$', '', 'g') as plain from documents where text is not null".format(_UNESC.format("regexp_replace(text, '<[^<>]*>', ' ', 'g')")),
    "link_list": r"""select link, count(distinct doc_id) as docs from (select doc_id, unnest(regexp_extract_all(text, 'https?://[^\s<>"'')\]]+', 0)) as link from documents) group by link""",
    "html_safe": f"select doc_id, {_ESC.format('text')} as safe from documents where text is not null",
    "highlight": r"select doc_id, regexp_replace(text, '(?i)(^|[^A-Za-z])(harb[A-Za-z]*)', '\1<mark>\2</mark>', 'g') as marked from documents where contains(lower(text), 'harb')",
    "checks_domain": """select 'span length' as check_name, cast(sent_id as varchar) as subject from gsents where span_end - span_start <> length(text)
        union all select 'empty text', cast(sent_id as varchar) from gsents where coalesce(trim(text), '') = ''
        union all select 'resent sentence', cast(sent_id as varchar) from gsents group by sent_id having count(*) > 1
        union all select 'chapter unknown', cast(chapter_id as varchar) from (select distinct chapter_id from gsents where chapter_id is not null and chapter_id not in (select chapter_id from chapter_refs where chapter_id is not null))
        union all select 'work unknown', work_id from (select distinct work_id from documents where work_id is not null and work_id not in (select work_id from works))
        union all select 'length', cast(doc_id as varchar) from documents where n_chars <> length(text)
        union all select 'no roster', cast(dialogue_id as varchar) from (select distinct dialogue_id from new_turns where dialogue_id not in (select dialogue_id from speakers))""",
    "span_gaps": "select chapter_id, sent_id from (select *, lag(span_end) over (partition by chapter_id order by seq, sent_id) as prev from (select distinct chapter_id, sent_id, seq, span_start, span_end from gsents)) where span_start <> prev + 1",
    "run_classify": f"with w as (select doc_id as seg, lang as declared, unnest({_W}) as term from documents), t as (select declared, term, row_number() over (partition by declared order by count(*) desc, term) as r from w where declared is not null group by declared, term), own as (select term, min(declared) as lang from t where r <= 40 group by term having count(*) = 1) select seg, lang, n from (select seg, lang, count(*) as n, row_number() over (partition by seg order by count(*) desc, lang) as r from w join own using (term) group by seg, lang) where r = 1",
    "bracket_classify": f"select {_KIND} as kind, count(*) as n from (select unnest(regexp_extract_all(text, '[(\\[]([^()\\[\\]]*)[)\\]]', 1)) as note from (select text from (select distinct sent_id, text from gsents) union all select text from documents)) group by 1",
    "probe_hits": f"with w as (select doc_id, {_W} as w from documents), p as (select distinct doc_id, array_to_string(w[i:i + 7], ' ') as h from (select doc_id, w, unnest(generate_series(1, len(w) - 7)) as i from w where len(w) >= 8)) select doc_id, count(*) as shared from p where h in (select h from p group by h having count(*) > 1) group by doc_id",
}
QUERIES = {f.__name__: f for f in (cite_scheme, cite_resolve, cite_mentions, column_enumeration, section_outline, html_plain, link_list, html_safe, highlight, checks_domain, span_gaps, run_classify, bracket_classify, probe_hits, pair_turns_lcs, pair_turns_filled, align_turns_zipped, chapter_margins, align_turns_nw, align_monotone, bead_align, page_blocks)}
