"""Lexicon, predicates, spans, and presentation models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import index, merge, spans, stats
from quire.sources.tables import read

# Enclitics of Latin words.
ENCLITICS = ("que", "ne", "ve")


def enclitic_hosts(s, d):
    """Latin words with their possible hosts: an enclitic stripped where two letters or more remain."""
    w = read(s, d, "gsents").where("lang = 'lat'").select(F.explode(T.words(F.col("text"))).alias("w")).distinct()
    hosts = F.array(*[F.when(F.col("w").endswith(e) & (F.length("w") > len(e) + 1), F.expr(f"left(w, length(w) - {len(e)})")) for e in ENCLITICS])
    return w.select("w", F.explode(F.array_compact(hosts)).alias("host"))


def caps_fallback(s, d):
    """Lexicon entries gathered under their unaccented capital form."""
    a = read(s, d, "analyses").select(T.letters_only(F.col("form")).alias("key"), "lemma").where("key <> ''").distinct()
    return a.groupBy("key").agg(F.countDistinct("lemma").alias("lemmas"), F.min("lemma").alias("first_lemma"))


def homonym_filter(s, d):
    """Readings whose class is that of their headword's own entry, then those that are no stub (a gloss of four letters or more); neither step to none."""
    a = read(s, d, "analyses").select("form", "lang", "lemma", "gloss", "parse").distinct()
    kind = F.regexp_extract(F.coalesce("parse", F.lit("")), "^([a-z]*)", 1)
    heads = a.where("form = lemma").groupBy("lang", "lemma").agg(F.min(kind).alias("head_kind"))
    w = Window.partitionBy("form", "lang")
    a = a.join(F.broadcast(heads), ["lang", "lemma"], "left").withColumn("fits", F.col("head_kind").isNull() | (kind == F.col("head_kind")))
    a = a.withColumn("any_fits", F.max("fits").over(w)).where("fits or not any_fits")
    a = a.withColumn("full", F.coalesce(F.length("gloss") >= 4, F.lit(False))).withColumn("any_full", F.max("full").over(w))
    return a.where("full or not any_full").select("form", "lang", "lemma", "parse")


def pos_class(s, d):
    """Readings by the class of word that their parse begins with."""
    kind = F.coalesce(F.nullif(F.regexp_extract(F.lower("parse"), r"^\s*([a-z]+)", 1), F.lit("")), F.lit("other"))
    return read(s, d, "analyses").groupBy("lang", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def short_gloss(s, d):
    """The first part of a gloss, at most 20 characters, without a final article."""
    g = T.collapse(F.regexp_extract("gloss", "^([^;,(]*)", 1))
    cut = F.when(F.length(g) > 20, F.regexp_replace(F.substring(g, 1, 20), r"\s+\S*$", "")).otherwise(g)
    return read(s, d, "analyses").where("gloss is not null").select("form", "lang", F.regexp_replace(cut, r" (a|an|the)$", "").alias("short")).distinct()


def shard_assign(s, d):
    key = F.coalesce(F.nullif(F.regexp_extract(T.strip_accents(F.lower("form")), "[a-z]", 0), F.lit("")), F.lit("_"))
    return read(s, d, "analyses").groupBy(key.alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.min("form").alias("first"), F.max("form").alias("last"))


def dict_topup(s, d):
    """Frequent words of the originals that the lexicon lacks."""
    w = read(s, d, "gsents").where("lang = 'lat'").select(F.explode(T.words(F.col("text"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n >= 5")
    return w.join(read(s, d, "analyses").select(F.lower("form").alias("w")).distinct(), "w", "left_anti")


def match_rate(s, d):
    w = read(s, d, "gsents").where("lang is not null").select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w")).where("w <> ''")
    a = read(s, d, "analyses").select("lang", F.lower("form").alias("w"), F.lit(1).alias("hit")).distinct()
    return w.join(a, ["lang", "w"], "left").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.try_divide(F.sum(F.coalesce("hit", F.lit(0))), F.count(F.lit(1))), 4).alias("rate"))


def parse_filter(s, d):
    """Unresolved readings go where the form has a resolved one with the same gloss."""
    a = read(s, d, "analyses").select("form", "lang", "lemma", "gloss").distinct()
    done = F.col("lemma").isNotNull()
    w = Window.partitionBy("form", "lang")
    keep = done | ~F.max(done).over(w) | ~(F.col("gloss").isNull() | F.array_contains(F.collect_set(F.when(done, F.col("gloss"))).over(w), F.col("gloss")))
    return a.withColumn("keep", keep).where("keep").select("form", "lang", "lemma", "gloss")


def facet_predicate(s, d):
    """Works that match every chosen facet; an empty choice matches all."""
    chosen: dict[str, list[str]] = {"lang": ["grc", "lat"], "scheme": [], "corpus_version": []}
    tests: list[Column] = [F.col(k).isin(v) for k, v in chosen.items() if v]
    return read(s, d, "works").where(reduce(Column.__and__, tests, F.lit(True))).select("work_id", "lang", "scheme")


def narrow_library(s, d):
    """A hit on the author keeps all works of the author, else only the works that match."""
    w = read(s, d, "works")
    q = "new"
    author = F.contains(T.fold(F.col("author")), F.lit(q))
    return w.where(author | F.contains(T.fold(F.col("title")), F.lit(q))).select("author", "title", author.alias("by_author"))


def version_predicate(s, d):
    return read(s, d, "works").select("work_id", F.coalesce(F.col("corpus_version").rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,63}$"), F.lit(False)).alias("valid"))


def safe_path(s, d):
    p = F.col("source_file")
    return read(s, d, "fragments").where("source_file is not null").select("source_file").distinct().select("source_file", (~p.rlike(r"(^|/)\.\.?(/|$)|\\|[\x00-\x1f]") & (F.length(p) <= 512)).alias("safe"))


def looks_like_citation(s, d):
    forms = [r"^\d+[a-e]\d*$", r"^\d+\.\d+(\.\d+)?$", r"^[AB] ?\d+$", r"^\d+$"]
    loc = read(s, d, "documents").where("locus is not null").select("doc_id", "locus")
    return loc.select("doc_id", reduce(Column.__or__, [F.col("locus").rlike(f) for f in forms]).alias("looks"))


def two_sided(s, d):
    """Fragments without a kind whose neighbours on both sides have the same one."""
    f = read(s, d, "fragments").select("frag_id", "source_file", "kind").distinct()
    w = Window.partitionBy("source_file").orderBy("frag_id")
    before = F.last("kind", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("kind", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return f.withColumn("b", before).withColumn("a", after).where("kind is null and a = b").select("frag_id", F.col("a").alias("kind"))


def longest_prefix(s, d):
    """For each document the longest work title that it names anywhere: word sequences joined with the titles by equality."""
    w = read(s, d, "works").select("work_id", T.words(F.col("title")).alias("t")).where("size(t) > 0").select("work_id", F.array_join("t", " ").alias("t"), F.size("t").alias("n"))
    # Titles come in few lengths; each gives one sequence for each word of a text.
    sizes = sorted(r["n"] for r in w.select("n").distinct().collect())
    words = read(s, d, "documents").where("text is not null").select("doc_id", T.words(F.col("text")).alias("w"))

    def grams(n: int) -> Column:
        return F.transform("w", lambda _, i: F.when(i + n <= F.size("w"), F.array_join(F.slice("w", i + 1, n), " ")))

    runs = F.flatten(F.array(*map(grams, sizes)))
    hit = words.select("doc_id", F.explode(F.array_distinct(runs)).alias("t")).where("t is not null").join(w.select("work_id", "t"), "t")
    return hit.groupBy("doc_id").agg(F.max_by("work_id", F.struct(F.length("t"), "work_id")).alias("work_id"))


def bridge(s, d):
    """Works to the languages of their translations through the chapters."""
    c = read(s, d, "chapter_refs").select("work_id", F.explode(F.array("ross_lang", "ref_lang")).alias("lang")).where("lang is not null")
    return c.join(read(s, d, "works").select("work_id", "title"), "work_id").groupBy("title", "lang").agg(F.count(F.lit(1)).alias("n"))


def fingerprint(s, d):
    """One hash for each work over its chapters in order: of the hashes of each thousand ids, so that no row grows with a work's texts."""
    c = read(s, d, "chapter_refs").select("work_id", "chapter_id", F.coalesce(F.sha2("ross_text", 256), F.lit("-")).alias("h")).distinct()

    def chained(order: str):
        rows = F.array_sort(F.collect_list(F.struct(order, "h")))
        return F.sha2(F.array_join(F.transform(rows, lambda x: x["h"]), ","), 256)

    part = c.groupBy("work_id", F.floor(F.col("chapter_id") / 1000).alias("part")).agg(chained("chapter_id").alias("h"))
    return part.groupBy("work_id").agg(chained("part").alias("fingerprint"))


def column_ranges(s, d):
    """First and last translated chapter of each book; of all chapters where none is translated."""
    c = read(s, d, "chapter_refs").select("work_id", "book", "chapter_id", F.col("ross_text").isNotNull().alias("t")).distinct()
    pick = lambda f: F.coalesce(f(F.when(F.col("t"), F.col("chapter_id"))), f("chapter_id"))
    return c.groupBy("work_id", "book").agg(pick(F.min).alias("lo"), pick(F.max).alias("hi")).withColumn("book", F.col("book").cast("long"))


def independent_evidence(s, d):
    """Most disjoint intervals of each supplier over all of its lines."""
    e = read(s, d, "lineitem").select("l_suppkey", "l_orderkey", (F.col("l_orderkey") + F.col("l_quantity").cast("long")).alias("to"))
    return spans.disjoint(e, "l_suppkey", "l_orderkey", "to")


def tick_windows(s, d):
    """Every fifth sentence of a chapter with its neighbours."""
    g = read(s, d, "gsents").where("chapter_id is not null").select("chapter_id", "sent_id", "seq").distinct()
    w = Window.partitionBy("chapter_id").orderBy("seq", "sent_id")
    near = F.array_join(F.collect_list("sent_id").over(w.rowsBetween(-1, 1)), ",")
    return g.withColumn("n", F.row_number().over(w)).withColumn("near", near).where("n = 1 or n % 5 = 0").select("chapter_id", "sent_id", "near")


def straddle(s, d):
    """Spans that begin one after the last one's end begin there, others at their own start."""
    g = read(s, d, "gsents").where("span_start is not null and span_end is not null").select("chapter_id", "sent_id", "seq", "span_start", "span_end").distinct()
    before = F.lag("span_end").over(Window.partitionBy("chapter_id").orderBy("seq", "sent_id"))
    return g.select("sent_id", F.when(F.col("span_start") == before + 1, before).otherwise(F.col("span_start")).cast("long").alias("eff_start"))


def patch_overlay(s, d):
    """A note's non-empty later text over its first."""
    f = read(s, d, "fragments").select("frag_id", "source_file", "column_key", "text").distinct().where("source_file is not null and column_key is not null")
    w = [F.when(F.coalesce("text", F.lit("")) == "", 1).otherwise(0), F.col("frag_id").desc()]
    return merge.last_writer(f.withColumn("k", F.concat_ws("#", "source_file", "column_key")), "k", w).select("k", "frag_id")


def interpolate_lines(s, d):
    """Where each line of an original would stand in its translation, between the chapter's ends."""
    c = read(s, d, "chapter_refs").where("length(ross_text) > 0").select("chapter_id", "greek_lines", F.length("ross_text").alias("len")).dropDuplicates(["chapter_id"]).where("size(greek_lines) > 1")
    knots = c.select("chapter_id", F.explode(F.array(F.struct(F.lit(0).alias("w"), F.lit(0).alias("off")), F.struct((F.element_at("greek_lines", -1)["cum_words"] + 10).alias("w"), F.col("len").alias("off")))).alias("k")).select("chapter_id", "k.*")
    pts = c.select("chapter_id", F.explode("greek_lines").alias("l")).select("chapter_id", F.col("l.citation").alias("citation"), F.col("l.cum_words").alias("w"))
    return spans.interpolate(knots, pts, ["chapter_id"], "w", "off").select("chapter_id", "citation", F.round("off_at", 3).alias("off_at"))


def snap_offsets(s, d):
    """Middle of each document, moved to the nearest word start; 0 for an empty text, no row for a null one."""
    docs = read(s, d, "documents").where("text is not null").select("doc_id", F.col("text").alias("t"), F.floor(F.length("text") / 2).cast("int").alias("mid"))
    return docs.select("doc_id", spans.snap_to_word(F.col("t"), F.col("mid")).cast("long").alias("at"))


def lemma_index(s, d):
    """Browse index: words seen three times or more with totals and works."""
    i = index.postings(read(s, d, "documents"), "doc_id", "text", ["work_id"])
    # Counted by work first: what moves are words, not their places.
    n = i.groupBy("term", "work_id").agg(F.count(F.lit(1)).alias("n")).groupBy("term").agg(F.sum("n").alias("n"), F.count("work_id").alias("works")).where("n >= 3")
    return n.select("term", "n", "works")


def word_lookup(s, d):
    """Words of all originals with their first gloss."""
    g = read(s, d, "gsents").select("sent_id", "text").distinct()
    w = g.select("sent_id", F.posexplode(F.split("text", r"[\s.,;]+")).alias("pos", "form")).where("form <> ''")
    # Analyses have a fixed size.
    a = read(s, d, "analyses").groupBy("form").agg(F.min("gloss").alias("gloss"))
    return w.join(F.broadcast(a), "form", "left").select("sent_id", F.col("pos").cast("long").alias("pos"), "form", "gloss")


def navigation(s, d):
    """Author, works and books as one row an author."""
    w = read(s, d, "works")
    return w.groupBy("author").agg(F.array_join(F.array_sort(F.collect_set("title")), "; ").alias("titles"), F.sum("n_books").alias("books"))


def latest_version(s, d):
    w = read(s, d, "works").where("corpus_version is not null")
    return stats.top_k(w, ["scheme"], [F.col("released_at").desc(), F.col("work_id")], 1).select("scheme", "work_id", "corpus_version")


_W = r"regexp_extract_all(lower(text), '([a-z'']+)', 1)"
_LAT = f"(select unnest({_W}) as w from gsents where lang = 'lat')"
_KEY = r"regexp_replace(replace(strip_accents(lower(form)), 'ς', 'σ'), '[^\p{L}]+', '', 'g')"
SQL = {
    "enclitic_hosts": f"select w, left(w, length(w) - length(e)) as host from (select distinct w from {_LAT}), (select unnest(['que', 'ne', 've']) as e) where ends_with(w, e) and length(w) > length(e) + 1",
    "caps_fallback": f"select key, count(distinct lemma) as lemmas, min(lemma) as first_lemma from (select {_KEY} as key, lemma from analyses) where key <> '' group by key",
    "homonym_filter": "with a as (select distinct form, lang, lemma, gloss, parse from analyses), h as (select lang, lemma, min(regexp_extract(coalesce(parse, ''), '^([a-z]*)', 1)) as k from a where form = lemma group by all), f as (select a.*, coalesce(regexp_extract(coalesce(parse, ''), '^([a-z]*)', 1) = h.k, true) as fits from a left join h on h.lang is not distinct from a.lang and h.lemma = a.lemma), g as (select * from (select *, bool_or(fits) over (partition by form, lang) as af from f) where fits or not af), s as (select *, coalesce(length(gloss) >= 4, false) as is_full from g) select form, lang, lemma, parse from (select *, bool_or(is_full) over (partition by form, lang) as an from s) where is_full or not an",
    "pos_class": r"select lang, coalesce(nullif(regexp_extract(lower(parse), '^\s*([a-z]+)', 1), ''), 'other') as kind, count(*) as n from analyses group by 1, 2",
    "short_gloss": r"select distinct form, lang, regexp_replace(case when length(g) > 20 then regexp_replace(substring(g, 1, 20), '\s+\S*$', '') else g end, ' (a|an|the)$', '') as short from (select form, lang, trim(regexp_replace(regexp_extract(gloss, '^([^;,(]*)', 1), '\s+', ' ', 'g')) as g from analyses where gloss is not null)",
    "shard_assign": "select coalesce(nullif(regexp_extract(strip_accents(lower(form)), '[a-z]', 0), ''), '_') as shard, count(*) as n, min(form) as \"first\", max(form) as \"last\" from analyses group by 1",
    "dict_topup": f"select w, count(*) as n from {_LAT} where w not in (select lower(form) from analyses where form is not null) group by w having count(*) >= 5",
    "match_rate": r"with w as (select lang, w from (select lang, unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) as w from gsents where lang is not null) where w <> '') select w.lang, count(*) as n, round(sum(case when a.w is null then 0 else 1 end) / count(*), 4) as rate from w left join (select distinct lang, lower(form) as w from analyses) a on w.lang = a.lang and w.w = a.w group by w.lang",
    "parse_filter": "with a as (select distinct form, lang, lemma, gloss from analyses), x as (select *, bool_or(lemma is not null) over w as has_one, list(gloss) filter (where lemma is not null) over w as gs from a window w as (partition by form, lang)) select form, lang, lemma, gloss from x where lemma is not null or not has_one or not (gloss is null or coalesce(list_contains(gs, gloss), false))",
    "facet_predicate": "select work_id, lang, scheme from works where lang in ('grc', 'lat')",
    "narrow_library": "select author, title, contains(replace(replace(strip_accents(lower(author)), 'v', 'u'), 'j', 'i'), 'new') as by_author from works where contains(replace(replace(strip_accents(lower(author)), 'v', 'u'), 'j', 'i'), 'new') or contains(replace(replace(strip_accents(lower(title)), 'v', 'u'), 'j', 'i'), 'new')",
    "version_predicate": "select work_id, coalesce(regexp_matches(corpus_version, '^[A-Za-z0-9][A-Za-z0-9._-]{0,63}$'), false) as valid from works",
    "safe_path": r"select distinct source_file, not regexp_matches(source_file, '(^|/)\.\.?(/|$)|\\|[\x00-\x1f]') and length(source_file) <= 512 as safe from fragments where source_file is not null",
    "looks_like_citation": r"select doc_id, regexp_matches(locus, '^\d+[a-e]\d*$') or regexp_matches(locus, '^\d+\.\d+(\.\d+)?$') or regexp_matches(locus, '^[AB] ?\d+$') or regexp_matches(locus, '^\d+$') as looks from documents where locus is not null",
    "two_sided": "with f as (select distinct frag_id, source_file, kind from fragments), x as (select *, last_value(kind ignore nulls) over (partition by source_file order by frag_id rows between unbounded preceding and 1 preceding) as b, first_value(kind ignore nulls) over (partition by source_file order by frag_id rows between 1 following and unbounded following) as a from f) select frag_id, a as kind from x where kind is null and a = b",
    "longest_prefix": "with d as (select doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '([a-z'']+)', 1), ' ') || ' ' as b from documents where text is not null), w as (select work_id, array_to_string(regexp_extract_all(lower(title), '([a-z'']+)', 1), ' ') as t from works) select doc_id, arg_max(work_id, (length(t), work_id)) as work_id from d join w on t <> '' and contains(b, ' ' || t || ' ') group by doc_id",
    "bridge": "select title, lang, count(*) as n from (select work_id, unnest([ross_lang, ref_lang]) as lang from chapter_refs) c join (select work_id, title from works) w using (work_id) where lang is not null group by title, lang",
    "fingerprint": "select work_id, sha256(string_agg(h, ',' order by part)) as fingerprint from (select work_id, floor(chapter_id / 1000) as part, sha256(string_agg(h, ',' order by chapter_id)) as h from (select distinct work_id, chapter_id, coalesce(sha256(ross_text), '-') as h from chapter_refs) group by 1, 2) group by work_id",
    "column_ranges": "select work_id, cast(book as bigint) as book, coalesce(min(chapter_id) filter (where ross_text is not null), min(chapter_id)) as lo, coalesce(max(chapter_id) filter (where ross_text is not null), max(chapter_id)) as hi from chapter_refs group by work_id, book",
    "tick_windows": "select chapter_id, sent_id, near from (select *, row_number() over w as n, array_to_string(list(sent_id) over (partition by chapter_id order by seq, sent_id rows between 1 preceding and 1 following), ',') as near from (select distinct chapter_id, sent_id, seq from gsents where chapter_id is not null) window w as (partition by chapter_id order by seq, sent_id)) where n = 1 or n % 5 = 0",
    "straddle": "select sent_id, cast(case when span_start = b + 1 then b else span_start end as bigint) as eff_start from (select *, lag(span_end) over (partition by chapter_id order by seq, sent_id) as b from (select distinct chapter_id, sent_id, seq, span_start, span_end from gsents where span_start is not null and span_end is not null))",
    "patch_overlay": "select k, frag_id from (select source_file || '#' || column_key as k, frag_id, row_number() over (partition by source_file || '#' || column_key order by case when coalesce(text, '') = '' then 1 else 0 end, frag_id desc) as r from (select distinct frag_id, source_file, column_key, text from fragments) where source_file is not null and column_key is not null) where r = 1",
    "interpolate_lines": "select chapter_id, x.citation as citation, round(x.cum_words * len / (w + 10), 3) as off_at from (select distinct chapter_id, greek_lines[-1].cum_words as w, length(ross_text) as len, unnest(greek_lines) as x from chapter_refs where length(ross_text) > 0 and len(greek_lines) > 1)",
    "lemma_index": f"select term, count(*) as n, count(distinct work_id) as works from (select doc_id, work_id, unnest({_W}) as term from documents) group by term having count(*) >= 3",
    "word_lookup": r"with w as (select distinct sent_id, form, pos from (select sent_id, unnest(p) as form, generate_subscripts(p, 1) - 1 as pos from (select sent_id, regexp_split_to_array(text, '[\s.,;]+') as p from gsents)) where form <> '') select sent_id, pos, w.form, gloss from w left join (select form, min(gloss) as gloss from analyses group by form) a on w.form = a.form",
    "navigation": "select author, string_agg(distinct title, '; ' order by title) as titles, cast(sum(n_books) as bigint) as books from works group by author",
    "latest_version": "select scheme, work_id, corpus_version from (select *, row_number() over (partition by scheme order by released_at desc, work_id) as r from works where corpus_version is not null) where r = 1",
}
QUERIES = {f.__name__: f for f in (enclitic_hosts, caps_fallback, homonym_filter, pos_class, short_gloss, shard_assign, dict_topup, match_rate, parse_filter, facet_predicate, narrow_library, version_predicate, safe_path, looks_like_citation, two_sided, longest_prefix, bridge, fingerprint, column_ranges, independent_evidence, tick_windows, straddle, patch_overlay, interpolate_lines, snap_offsets, lemma_index, word_lookup, navigation, latest_version)}
