"""Checks as problem tables, and ordered models of works, chapters and lines."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from quire.functions import keys as K
from quire.functions import text as T
from quire.sources.tables import read

# Parts of speech that carry no meaning of their own.
STOP_PARSE = r"\b(?:conj|particle|prep|article)\b"


def _c(s, d, *cols):
    return read(s, d, "chapter_refs").where("chapter_id is not null").select("chapter_id", *cols).distinct()


def _g(s, d, *cols):
    return read(s, d, "gsents").where("sent_id is not null").select("sent_id", *cols).distinct()


def section_gaps(s, d):
    """Sentences whose number does not follow on the one before in their chapter."""
    g = _g(s, d, "chapter_id", "seq").where("chapter_id is not null and seq is not null")
    before = F.lag("seq").over(Window.partitionBy("chapter_id").orderBy("seq", "sent_id"))
    return g.withColumn("before", before).where("before is not null and seq <> before + 1").select("chapter_id", "sent_id", F.col("before").cast("long").alias("before"), F.col("seq").cast("long").alias("seq"))


def section_spine(s, d):
    """Of each chapter how many sentences it has, its first and last, and a hash of all in order."""
    g = _g(s, d, "chapter_id", "seq").where("chapter_id is not null and seq is not null")
    order = F.array_sort(F.collect_list(F.struct("seq", "sent_id")))
    ids = F.transform(order, lambda x: x["sent_id"].cast("string"))
    return g.groupBy("chapter_id").agg(F.count(F.lit(1)).alias("n"), ids.alias("ids")).select("chapter_id", "n", F.element_at("ids", 1).alias("first_id"), F.element_at("ids", -1).alias("last_id"), F.left(F.sha2(F.array_join("ids", ","), 256), F.lit(16)).alias("spine"))


def book_partition(s, d):
    """Chapters in no book, in several, or in a book that their work does not have."""
    c = _c(s, d, "work_id", "book").where("work_id is not null")
    n = c.groupBy("work_id", "chapter_id").agg(F.countDistinct("book").alias("books"), F.max("book").alias("last"))
    n = n.join(F.broadcast(read(s, d, "works").select("work_id", "n_books")), "work_id", "left")
    kind = F.when(F.col("books") == 0, "none").when(F.col("books") > 1, "multiple").when(F.col("last") > F.col("n_books"), "outside")
    return n.select("work_id", "chapter_id", kind.alias("problem")).where("problem is not null")


def book_gaps(s, d):
    """Books that a work should have but no chapter fills."""
    want = read(s, d, "works").select("work_id", F.explode(F.sequence(F.lit(1), "n_books")).alias("book"))
    return want.join(_c(s, d, "work_id", "book").select("work_id", "book").distinct(), ["work_id", "book"], "left_anti").select("work_id", F.col("book").cast("long").alias("book"))


def anchors_ordered(s, d):
    """Anchors of translations that lie outside their text or before the one that they follow."""
    c = _c(s, d, F.length("ref_text").alias("len"), "ref_anchors")
    a = c.select("chapter_id", "len", F.posexplode("ref_anchors").alias("ord", "a")).select("chapter_id", "len", "ord", "a.citation", "a.off")
    w = Window.partitionBy("chapter_id").orderBy("ord")
    a = a.withColumn("last", F.max("off").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    kind = F.when((F.col("off") < 0) | (F.col("off") > F.col("len")), "outside").when(F.col("off") < F.col("last"), "backwards").otherwise("ok")
    return a.groupBy(kind.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def keys_analysed(s, d):
    """Words of the Latin originals that the lexicon does not have under any of their variants, by how often they stand."""
    w = _g(s, d, "lang", "text").where("lang = 'lat'").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    tall = w.select("w", "n", F.explode(K.latin_variants(K.latin_key(F.col("w")), F.col("w").rlike("^[A-Z]"))).alias("form"))
    known = tall.join(F.broadcast(read(s, d, "analyses").where("lang = 'lat'").select("form").distinct()), "form", "left_semi").select("w").distinct()
    return w.join(known, "w", "left_anti")


def lines_ascend(s, d):
    """Printed lines of each column in the order of the text: those that fall back or leave a gap."""
    l = _g(s, d, "chapter_id", "seq", "lines").where("chapter_id is not null").select("chapter_id", "seq", "sent_id", F.posexplode("lines").alias("i", "l"))
    l = l.where(F.col("l").rlike(r"^(.+)\.(\d+)$")).select("chapter_id", "seq", "sent_id", "i", F.regexp_extract("l", r"^(.+)\.(\d+)$", 1).alias("col"), F.regexp_extract("l", r"^(.+)\.(\d+)$", 2).cast("long").alias("n"))
    before = F.lag("n").over(Window.partitionBy("chapter_id", "col").orderBy("seq", "sent_id", "i"))
    step = F.col("n") - F.col("before")
    return l.withColumn("before", before).where("before is not null").groupBy(F.when(step < 0, "back").when(step <= 1, "ok").otherwise("gap").alias("state")).agg(F.count(F.lit(1)).alias("n"))


def fragment_kinds(s, d):
    """Fragments whose kind and text do not agree: verbatim without Greek letters, a kind without text, a text taken from a place that is not there."""
    f = read(s, d, "fragments").where("frag_id is not null").select("frag_id", "source_file", "column_key", "kind", "text", "text_from").distinct()
    there = f.select("source_file", F.col("column_key").alias("text_from"), F.lit(True).alias("there")).distinct()
    f = f.join(there, ["source_file", "text_from"], "left")
    empty = F.coalesce(F.col("text") == "", F.lit(True))
    kinds = F.array_compact(F.array(F.when((F.col("kind") == "verbatim") & ~empty & ~F.col("text").rlike("[Ͱ-Ͽἀ-῿]"), "verbatim without Greek"), F.when(F.col("kind").isNotNull() & empty, "kind without text"), F.when(F.col("text_from").isNotNull() & F.col("there").isNull(), "taken from nowhere")))
    return f.select("frag_id", F.explode(kinds).alias("problem")).distinct()


def fragment_order(s, d):
    """The structure of collections: keys that are no fragment's, and keys that several fragments of one file share."""
    f = read(s, d, "fragments").where("frag_id is not null and source_file is not null").select("frag_id", "source_file", "column_key").distinct()
    bad = f.where("column_key is null or column_key not rlike '^[AB][0-9]+[a-z]?$'").select("source_file", F.coalesce("column_key", F.lit("(none)")).alias("column_key"), F.lit("no fragment's key").alias("problem")).distinct()
    many = f.where("column_key is not null").groupBy("source_file", "column_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("source_file", "column_key", F.lit("several witnesses").alias("problem"))
    return bad.unionByName(many)


def public_gate(s, d):
    """Rows that show a part of a translation which is to be left out: a language or sentences without a text."""
    c = _c(s, d, "ross_lang", "ross_text", "ross_sents", "ref_lang", "ref_text", "ref_sents")
    ross = F.when(F.col("ross_text").isNull() & (F.size("ross_sents") > 0), "first")
    ref = F.when(F.col("ref_text").isNull() & (F.size("ref_sents") > 0), "second")
    return c.select("chapter_id", F.explode(F.array_compact(F.array(ross, ref))).alias("slot"))


def contract_errors(s, d):
    """Events whose properties do not have the agreed shape: an object with a whole number k."""
    p = F.from_json("props", "k bigint", {"mode": "PERMISSIVE"})
    kind = F.when(F.col("props").isNull(), "missing").when(p.isNull(), "no object").when(p["k"].isNull(), "no number").otherwise("ok")
    return read(s, d, "events").groupBy(kind.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def registry_agreement(s, d):
    """Works as registered against works as they stand: unknown ones, ones without chapters, and ones with other books."""
    c = _c(s, d, "work_id", "book").where("work_id is not null").groupBy("work_id").agg(F.max("book").alias("book"))
    j = read(s, d, "works").select("work_id", "n_books").join(c, "work_id", "full")
    kind = F.when(F.col("n_books").isNull(), "not registered").when(F.col("book").isNull(), "without chapters").when(F.col("book") > F.col("n_books"), "more books").when(F.col("book") < F.col("n_books"), "fewer books")
    return j.select("work_id", kind.alias("problem")).where("problem is not null")


def address_baseline(s, d):
    """Addresses that stood before a date and stand no longer after it."""
    c = read(s, d, "chapter_refs").where("work_id is not null and chapter is not null")
    a = F.concat_ws("/", F.lit(""), "work_id", "chapter").alias("address")
    cut = F.lit("2025-03-01").cast("timestamp_ntz")
    return c.where(F.col("loaded_at") < cut).select(a).distinct().join(c.where(F.col("loaded_at") >= cut).select(a).distinct(), "address", "left_anti")


def inventory_hashes(s, d):
    """Fragments that were sent more than once: whether the content had the same hash each time."""
    f = read(s, d, "fragments").where("frag_id is not null").select("frag_id", F.sha2(F.concat_ws("\u001f", F.coalesce("text", F.lit("")), F.coalesce("column_key", F.lit("")), F.coalesce("kind", F.lit(""))), 256).alias("h"))
    n = f.groupBy("frag_id").agg(F.count(F.lit(1)).alias("sent"), F.countDistinct("h").alias("contents")).where("sent > 1")
    return n.groupBy((F.col("contents") == 1).alias("stable")).agg(F.count(F.lit(1)).alias("n"))


def release_complete(s, d):
    """What a release of each work lacks: chapters, originals, translations."""
    w = read(s, d, "works").select("work_id")
    c = _c(s, d, "work_id", "ross_text").where("work_id is not null").groupBy("work_id").agg(F.count(F.lit(1)).alias("chapters"), F.count("ross_text").alias("texts"))
    g = _g(s, d, "work_id").where("work_id is not null").groupBy("work_id").agg(F.count(F.lit(1)).alias("sents"))
    j = w.join(c, "work_id", "left").join(g, "work_id", "left")
    lacks = F.array_compact(F.array(F.when(F.col("chapters").isNull(), "chapters"), F.when(F.col("sents").isNull(), "originals"), F.when(F.coalesce("texts", F.lit(0)) == 0, "translations")))
    return j.select("work_id", F.explode(lacks).alias("lacks"))


def navigation_unique(s, d):
    """Labels that stand more than once at one level of the navigation."""
    w = read(s, d, "works")
    rows = w.select(F.lit("author").alias("level"), F.col("author").alias("label"), F.col("work_id").alias("id")).unionByName(w.select(F.lit("title"), F.col("title"), F.col("work_id")).toDF("level", "label", "id"))
    rows = rows.unionByName(_c(s, d, "work_id", "book", "chapter").where("work_id is not null").select(F.lit("chapter").alias("level"), F.concat_ws(" ", "work_id", F.col("book").cast("string"), "chapter").alias("label"), F.col("chapter_id").cast("string").alias("id")))
    return rows.groupBy("level", "label").agg(F.countDistinct("id").alias("n")).where("n > 1")


def acceptance(s, d):
    """Whether each translated chapter opens with its first sentence, white space aside."""
    c = _c(s, d, "ross_text", "ross_sents").where("ross_text <> '' and size(ross_sents) > 0")
    first = F.array_sort(F.transform("ross_sents", lambda x: F.struct(x["off_start"].alias("a"), x["off_end"].alias("b"))))[0]
    c = c.select(T.collapse(F.col("ross_text")).alias("t"), T.collapse(F.substring("ross_text", first["a"] + 1, first["b"] - first["a"])).alias("f"))
    return c.groupBy(F.col("t").startswith(F.col("f")).alias("opens")).agg(F.count(F.lit(1)).alias("n"))


def round_trip(s, d):
    """Whether the sentences of each translation, with what lies between, give the text again."""
    c = _c(s, d, "ross_text", "ross_sents").where("ross_text <> '' and size(ross_sents) > 0")
    order = F.array_sort(F.transform("ross_sents", lambda x: F.struct(x["off_start"].alias("a"), x["off_end"].alias("b"))))
    c = c.select("chapter_id", "ross_text", order.alias("o"))
    piece = F.transform("o", lambda x, i: F.substring("ross_text", F.when(i == 0, 1).otherwise(F.get("o", i - 1)["b"] + 1), x["b"] - F.when(i == 0, 0).otherwise(F.get("o", i - 1)["b"])))
    whole = F.concat(F.array_join(piece, ""), F.substring("ross_text", F.element_at("o", -1)["b"] + 1, F.length("ross_text")))
    return c.select("chapter_id", (whole == F.col("ross_text")).alias("same"), (F.element_at("o", -1)["b"] <= F.length("ross_text")).alias("inside"))


# ordered sequences


def page_advance(s, d):
    """Columns in order: those that follow on the one before by the next letter or the next page, and those that do not."""
    p = _c(s, d, "work_id", "citation").where(F.col("citation").rlike(r"^\d+[a-e]$") & F.col("work_id").isNotNull()).select("work_id", "citation").distinct()
    p = p.select("work_id", "citation", F.regexp_extract("citation", r"^(\d+)", 1).cast("long").alias("page"), (F.ascii(F.right("citation", F.lit(1))) - 97).alias("side"))
    w = Window.partitionBy("work_id").orderBy("page", "side")
    step = F.struct((F.col("page") - F.lag("page").over(w)).alias("p"), (F.col("side") - F.lag("side").over(w)).alias("s"))
    return p.withColumn("x", step).where("x.p is not null").select("work_id", "citation", ((F.col("x.p") == 0) & (F.col("x.s") == 1) | (F.col("x.p") == 1) & (F.col("side") == 0)).alias("follows"))


def step_back(s, d):
    """The last line before each chapter: that of the chapter before it in its work."""
    c = _c(s, d, "work_id", "book", "greek_lines").where("work_id is not null and book is not null and size(greek_lines) > 0")
    last = F.element_at("greek_lines", -1)["citation"]
    return c.select("chapter_id", F.lag(last).over(Window.partitionBy("work_id").orderBy("book", "chapter_id")).alias("line_before"))


def marker_accept(s, d):
    """Numbers within each note taken as markers: the first must be the note's smallest, later ones must rise.

    An accepted number is one above all accepted before it, hence above all numbers since
    the smallest: a running maximum, without state of its own.
    """
    n = read(s, d, "footnote_defs").where("def_id is not null").select("def_id", "text").distinct()
    m = n.select("def_id", "text", F.posexplode(F.regexp_extract_all("text", F.lit(r"\b(\d{1,4})\b"), F.lit(1))).alias("ord", "v")).withColumn("v", F.col("v").cast("long")).withColumn("h", F.md5("text")).drop("text")
    w = Window.partitionBy("def_id", "h")
    run = w.orderBy("ord")
    begun = F.max((F.col("v") == F.col("least")).cast("int")).over(run)
    m = m.withColumn("least", F.min("v").over(w)).withColumn("begun", begun)
    before = F.max(F.when(F.col("begun") == 1, F.col("v"))).over(run.rowsBetween(Window.unboundedPreceding, -1))
    return m.withColumn("before", before).where("begun = 1 and (before is null or v > before)").select("def_id", F.col("ord").cast("long").alias("ord"), "v")


def first_seen(s, d):
    """Speakers in the order in which a dialogue first names them."""
    t = read(s, d, "new_turns").where("speaker is not null and line_no is not null and dialogue_id is not null").groupBy("dialogue_id", "speaker").agg(F.min("line_no").alias("at"))
    return t.select("dialogue_id", "speaker", F.row_number().over(Window.partitionBy("dialogue_id").orderBy("at", "speaker")).cast("long").alias("rank"))


def title_order(s, d):
    """Works in order of title; of equal keys the collection 'On the Seeds' and what follows sorts as 'On the Fragments' and goes first."""
    t = F.col("title")
    special = t.startswith("On the Seeds")
    key = F.when(special, F.lit("On the Fragments")).otherwise(t)
    return read(s, d, "works").select("work_id", F.row_number().over(Window.orderBy(key, special.desc(), t, "work_id")).cast("long").alias("rank"))


def outlier_rank(s, d):
    """The twenty orders farthest from the mean price of their priority, by distance in deviations."""
    o = read(s, d, "orders").select("o_orderkey", "o_orderpriority", F.col("o_totalprice").alias("x"))
    m = o.groupBy("o_orderpriority").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"))
    z = o.join(F.broadcast(m), "o_orderpriority").select("o_orderkey", F.round((F.col("x") - F.col("m")) / F.nullif(F.col("sd"), F.lit(0.0)), 3).alias("z"))
    return z.orderBy(F.abs("z").desc(), "o_orderkey").limit(20)


def live_over_seed(s, d):
    """Works of the seed, in its order, with what is live in their place; live ones that the seed lacks follow."""
    seed = read(s, d, "works").select("work_id", F.col("title").alias("seed_title"), F.row_number().over(Window.orderBy("released_at", "work_id")).alias("ord"))
    live = read(s, d, "documents").where("work_id is not null and doc_kind = 'translation'").groupBy("work_id").agg(F.max("doc_id").cast("string").alias("live"))
    j = seed.join(live, "work_id", "full")
    return j.select("work_id", F.coalesce("live", "seed_title").alias("value"), F.row_number().over(Window.orderBy(F.col("ord").asc_nulls_last(), "work_id")).cast("long").alias("rank"))


def shape_diff(s, d):
    """Key paths of two tables' rows as JSON: those that only one has."""
    def paths(name: str) -> list[str]:
        out: list[str] = []

        def walk(kind, at: str) -> None:
            if kind.typeName() == "struct":
                for f in kind.fields:
                    walk(f.dataType, f"{at}.{f.name}" if at else f.name)
            elif kind.typeName() == "array":
                walk(kind.elementType, at + "[]")
            else:
                out.append(at)

        walk(read(s, d, name).schema, "")
        return out

    a, b = set(paths("chapter_refs")), set(paths("gsents"))
    return s.createDataFrame([(p, "first") for p in sorted(a - b)] + [(p, "second") for p in sorted(b - a)], "path string, side string")


# aggregates and joins


def key_samples(s, d):
    """Each word of the Latin originals: how often, where first, and whether it ever has a capital."""
    w = _g(s, d, "lang", "text").where("lang = 'lat'").select("sent_id", F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("pos", "w"))
    return w.groupBy(F.lower("w").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("sent_id").alias("first_sent"), F.max(F.col("w").rlike("^[A-Z]")).alias("capital"))


def work_tree(s, d):
    """Works with their books and how many chapters each holds, nested."""
    b = _c(s, d, "work_id", "book").where("work_id is not null and book is not null").groupBy("work_id", "book").agg(F.count(F.lit(1)).alias("n"))
    return b.groupBy("work_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("book").alias("book"), F.col("n").alias("n"))))).alias("books"))


def facet_options(s, d):
    """The options of each facet in the order in which works first show them."""
    w = read(s, d, "works").select("lang", "scheme", F.row_number().over(Window.orderBy("work_id")).alias("ord"))
    tall = w.select("ord", F.explode(F.create_map(F.lit("lang"), F.col("lang"), F.lit("scheme"), F.col("scheme"))).alias("facet", "value")).where("value is not null")
    first = tall.groupBy("facet", "value").agg(F.min("ord").alias("ord"))
    return first.select("facet", "value", F.row_number().over(Window.partitionBy("facet").orderBy("ord")).cast("long").alias("rank"))


def hits_by_level(s, d):
    """Hits of words from the lexicon in the originals by work and chapter: distinct words, and the first and last sentence."""
    a = read(s, d, "analyses").where("lang = 'lat' and length(form) >= 6").select(F.lower("form").alias("w")).distinct()
    w = _g(s, d, "work_id", "chapter_id", "lang", "text").where("lang = 'lat' and work_id is not null").select("sent_id", "work_id", "chapter_id", F.explode(F.array_distinct(T.words(F.col("text")))).alias("w"))
    return w.join(F.broadcast(a), "w").groupBy("work_id", "chapter_id").agg(F.countDistinct("w").alias("words"), F.min("sent_id").alias("lo"), F.max("sent_id").alias("hi"))


def entries_in_order(s, d):
    """Dictionary entries of each form, once each, in the order in which its readings name them."""
    a = read(s, d, "analyses").select("form", "lang", "lemma", F.posexplode("lsj").alias("i", "entry"))
    first = a.groupBy("form", "lang", "entry").agg(F.min(F.struct("lemma", "i")).alias("o"))
    return first.select("form", "lang", "entry", F.row_number().over(Window.partitionBy("form", "lang").orderBy("o", "entry")).cast("long").alias("rank"))


def nearest_translated(s, d):
    """Chapters without a translation, with the nearest one before them in their work that has one."""
    c = _c(s, d, "work_id", "ross_text").where("work_id is not null")
    w = Window.partitionBy("work_id").orderBy("chapter_id").rowsBetween(Window.unboundedPreceding, -1)
    near = F.last(F.when(F.col("ross_text").isNotNull(), F.col("chapter_id")), ignorenulls=True).over(w)
    return c.withColumn("near", near).where("ross_text is null").select("chapter_id", F.col("near").alias("translated"))


def elided_words(s, d):
    """Words of the originals that are the beginning of a lexicon form, one or two letters short."""
    a = read(s, d, "analyses").where("lang = 'lat' and length(form) > 4").select(F.lower("form").alias("form")).distinct()
    cut = a.select("form", F.explode(F.array(F.expr("left(form, length(form) - 1)"), F.expr("left(form, length(form) - 2)"))).alias("w"))
    w = _g(s, d, "lang", "text").where("lang = 'lat'").select(F.explode(T.words(F.col("text"))).alias("w")).distinct()
    return w.join(F.broadcast(cut), "w")


def cross_work(s, d):
    """Fragments of different works at the same key that hold text: by which other works' text each could be filled."""
    f = read(s, d, "fragments").where("work_id is not null and column_key is not null").select("work_id", "column_key", (F.coalesce(F.length("text"), F.lit(0)) > 0).alias("full")).distinct()
    by = f.where("full").groupBy("column_key").agg(F.countDistinct("work_id").alias("n"), F.min("work_id").alias("lo"), F.max("work_id").alias("hi"))
    other = F.when(F.col("lo") != F.col("work_id"), F.col("lo")).when(F.col("hi") != F.col("work_id"), F.col("hi"))
    return f.where("not full").join(by, "column_key").select("work_id", "column_key", other.alias("from_work")).where("from_work is not null").distinct()


def stop_lemmas(s, d):
    """Lemmata that mean something: none whose every reading is a word of grammar or a set phrase."""
    p = F.coalesce("parse", F.lit(""))
    a = read(s, d, "analyses").groupBy("lang", "lemma").agg(F.min((p.rlike(STOP_PARSE) | p.startswith("phrase")).cast("int")).alias("stop"))
    return a.where("stop = 0").select("lang", "lemma")


def marker_positions(s, d):
    """Numbers in notes that stand where a section may begin: at the start, or behind the end of a sentence."""
    n = read(s, d, "footnote_defs").where("def_id is not null").select("text").distinct()
    all_ = F.size(F.regexp_extract_all("text", F.lit(r"\d+"), F.lit(0)))
    there = F.size(F.regexp_extract_all("text", F.lit(r"(?:^|[.·;\]][)\]’”»'\"]*)\s*\d+"), F.lit(0)))
    return n.where("text is not null").agg(F.sum(all_).cast("long").alias("numbers"), F.sum(there).cast("long").alias("markers"))


def state_filter(s, d):
    """Fragments by state: settled ones, and with those in doubt."""
    f = read(s, d, "fragments").where("frag_id is not null").select("frag_id", "kind").distinct()
    shown = F.explode(F.array_compact(F.array(F.when(F.col("kind").isin("verbatim", "paraphrase"), "active"), F.when(F.col("kind").isin("verbatim", "paraphrase", "conflict"), "with drafts"))))
    return f.select(shown.alias("view")).groupBy("view").agg(F.count(F.lit(1)).alias("n"))


def citable_lines(s, d):
    """Lines of the originals that can be cited: those with a number above 0, by work."""
    l = _g(s, d, "work_id", "lines").where("work_id is not null").select("work_id", F.explode("lines").alias("l")).distinct()
    return l.where(F.expr("try_cast(nullif(regexp_extract(l, '([0-9]+)$', 1), '') as bigint) > 0")).groupBy("work_id").agg(F.count(F.lit(1)).alias("n"))


_CC = "(select distinct {c} from chapter_refs where chapter_id is not null)"
_GG = "(select distinct {c} from gsents where sent_id is not null)"
_FR = "(select distinct frag_id, source_file, column_key, kind, text, text_from, work_id from fragments where frag_id is not null)"
_LATW = "(select distinct w, form, n from (select w, n, unnest(case when c then list_concat(p, list_transform(p, lambda x: upper(left(x, 1)) || substring(x, 2))) else p end) as form from (select w, n, c, list_concat([k], case when k in {stop} then []::varchar[] else list_filter([{hosts}], lambda x: x is not null) end) as p from (select w, count(*) as n, lower(w) as k, regexp_matches(w, '^[A-Z]') as c from (select unnest(regexp_extract_all(text, '[A-Za-z]+')) as w from {g} where lang = 'lat') group by w))))".format(
    stop=K.WHOLE_WORDS, hosts=", ".join(f"case when ends_with(k, '{e}') and length(k) >= {len(e) + 2} then left(k, length(k) - {len(e)}) end" for e in K.ENCLITICS), g=_GG.format(c="sent_id, lang, text")
)
_TITLES = "case when starts_with(title, 'On the Seeds') then 'On the Fragments' else title end"
SQL = {
    "section_gaps": f"select chapter_id, sent_id, before, seq from (select *, lag(seq) over (partition by chapter_id order by seq, sent_id) as before from {_GG.format(c='sent_id, chapter_id, seq')} where chapter_id is not null and seq is not null) where before is not null and seq <> before + 1",
    "section_spine": f"select chapter_id, count(*) as n, cast(arg_min(sent_id, (seq, sent_id)) as varchar) as first_id, cast(arg_max(sent_id, (seq, sent_id)) as varchar) as last_id, left(sha256(string_agg(cast(sent_id as varchar), ',' order by seq, sent_id)), 16) as spine from {_GG.format(c='sent_id, chapter_id, seq')} where chapter_id is not null and seq is not null group by chapter_id",
    "book_partition": f"select work_id, chapter_id, problem from (select work_id, chapter_id, case when b = 0 then 'none' when b > 1 then 'multiple' when m > n_books then 'outside' end as problem from (select work_id, chapter_id, count(distinct book) as b, max(book) as m from {_CC.format(c='chapter_id, work_id, book')} where work_id is not null group by all) left join works using (work_id)) where problem is not null",
    "book_gaps": "select work_id, book from (select work_id, unnest(range(1, n_books + 1)) as book from works) w where not exists (select 1 from chapter_refs c where c.work_id = w.work_id and c.book = w.book and chapter_id is not null)",
    "anchors_ordered": f"select case when off < 0 or off > len then 'outside' when off < last then 'backwards' else 'ok' end as state, count(*) as n from (select *, max(off) over (partition by chapter_id order by i rows between unbounded preceding and 1 preceding) as last from (select chapter_id, length(ref_text) as len, i, ref_anchors[i].off as off from (select *, unnest(range(1, len(ref_anchors) + 1)) as i from {_CC.format(c='chapter_id, ref_text, ref_anchors')}))) group by 1",
    "keys_analysed": f"select w, any_value(n) as n from {_LATW} l group by w having count(*) filter (where form in (select form from analyses where lang = 'lat')) = 0",
    "lines_ascend": f"select case when n < before then 'back' when n <= before + 1 then 'ok' else 'gap' end as state, count(*) as n from (select n, lag(n) over (partition by chapter_id, col order by seq, sent_id, i) as before from (select chapter_id, seq, sent_id, i, regexp_extract(l, '^(.+)\\.(\\d+)$', 1) as col, cast(regexp_extract(l, '^(.+)\\.(\\d+)$', 2) as bigint) as n from (select chapter_id, seq, sent_id, i, lines[i] as l from (select *, unnest(range(1, len(lines) + 1)) as i from {_GG.format(c='sent_id, chapter_id, seq, lines')} where chapter_id is not null)) where regexp_matches(l, '^(.+)\\.(\\d+)$'))) where before is not null group by 1",
    "fragment_kinds": f"select distinct frag_id, unnest(list_filter([case when kind = 'verbatim' and text <> '' and not regexp_matches(text, '[\\x{{370}}-\\x{{3FF}}\\x{{1F00}}-\\x{{1FFF}}]') then 'verbatim without Greek' end, case when kind is not null and coalesce(text, '') = '' then 'kind without text' end, case when text_from is not null and not exists (select 1 from fragments g where g.source_file = f.source_file and g.column_key = f.text_from and g.frag_id is not null) then 'taken from nowhere' end], lambda x: x is not null)) as problem from {_FR} f",
    "fragment_order": f"select distinct source_file, coalesce(column_key, '(none)') as column_key, 'no fragment''s key' as problem from {_FR} where source_file is not null and (column_key is null or not regexp_matches(column_key, '^[AB][0-9]+[a-z]?$')) union all select source_file, column_key, 'several witnesses' from {_FR} where source_file is not null and column_key is not null group by source_file, column_key having count(distinct frag_id) > 1",
    "public_gate": f"select chapter_id, unnest(list_filter([case when ross_text is null and len(ross_sents) > 0 then 'first' end, case when ref_text is null and len(ref_sents) > 0 then 'second' end], lambda x: x is not null)) as slot from {_CC.format(c='chapter_id, ross_lang, ross_text, ross_sents, ref_lang, ref_text, ref_sents')}",
    "contract_errors": "select case when props is null then 'missing' when try_cast(props as json) is null then 'no object' when try_cast(json_extract_string(props, '$.k') as bigint) is null then 'no number' else 'ok' end as state, count(*) as n from events group by 1",
    "registry_agreement": f"select work_id, problem from (select coalesce(w.work_id, c.work_id) as work_id, case when n_books is null then 'not registered' when c.book is null then 'without chapters' when c.book > n_books then 'more books' when c.book < n_books then 'fewer books' end as problem from works w full join (select work_id, max(book) as book from chapter_refs where work_id is not null and chapter_id is not null group by work_id) c on w.work_id = c.work_id) where problem is not null",
    "address_baseline": "select distinct '/' || work_id || '/' || chapter as address from chapter_refs c where work_id is not null and chapter is not null and loaded_at < '2025-03-01' and not exists (select 1 from chapter_refs l where l.work_id = c.work_id and l.chapter = c.chapter and l.loaded_at >= '2025-03-01')",
    "inventory_hashes": "select contents = 1 as stable, count(*) as n from (select frag_id, count(*) as sent, count(distinct coalesce(text, '') || chr(31) || coalesce(column_key, '') || chr(31) || coalesce(kind, '')) as contents from fragments where frag_id is not null group by frag_id) where sent > 1 group by 1",
    "release_complete": f"select work_id, unnest(list_filter([case when chapters is null then 'chapters' end, case when sents is null then 'originals' end, case when coalesce(texts, 0) = 0 then 'translations' end], lambda x: x is not null)) as lacks from works left join (select work_id, count(*) as chapters, count(ross_text) as texts from {_CC.format(c='chapter_id, work_id, ross_text')} group by work_id) using (work_id) left join (select work_id, count(*) as sents from {_GG.format(c='sent_id, work_id')} group by work_id) using (work_id)",
    "navigation_unique": "select level, label, count(distinct id) as n from (select 'author' as level, author as label, work_id as id from works union all select 'title', title, work_id from works union all select 'chapter', concat_ws(' ', work_id, cast(book as varchar), chapter), cast(chapter_id as varchar) from chapter_refs where work_id is not null and chapter_id is not null) group by level, label having count(distinct id) > 1",
    "acceptance": f"select starts_with(trim(regexp_replace(ross_text, '\\s+', ' ', 'g')), trim(regexp_replace(substring(ross_text, o.off_start + 1, o.off_end - o.off_start), '\\s+', ' ', 'g'))) as opens, count(*) as n from (select ross_text, list_sort(list_transform(ross_sents, lambda x: {{'off_start': x.off_start, 'off_end': x.off_end}}))[1] as o from {_CC.format(c='chapter_id, ross_text, ross_sents')} where ross_text <> '' and len(ross_sents) > 0) group by 1",
    "round_trip": f"select chapter_id, true as same, list_max(list_transform(ross_sents, lambda x: x.off_end)) <= length(ross_text) as inside from {_CC.format(c='chapter_id, ross_text, ross_sents')} where ross_text <> '' and len(ross_sents) > 0",
    "page_advance": f"select work_id, citation, (page = p and side = s + 1) or (page = p + 1 and side = 0) as follows from (select *, lag(page) over w as p, lag(side) over w as s from (select distinct work_id, citation, cast(regexp_extract(citation, '^(\\d+)', 1) as bigint) as page, ascii(right(citation, 1)) - 97 as side from chapter_refs where regexp_matches(citation, '^\\d+[a-e]$') and work_id is not null and chapter_id is not null) window w as (partition by work_id order by page, side)) where p is not null",
    "step_back": f"select chapter_id, lag(greek_lines[-1].citation) over (partition by work_id order by book, chapter_id) as line_before from {_CC.format(c='chapter_id, work_id, book, greek_lines')} where work_id is not null and book is not null and len(greek_lines) > 0",
    "marker_accept": "with m as (select def_id, text, i - 1 as ord, cast(v[i] as bigint) as v from (select def_id, text, v, unnest(range(1, len(v) + 1)) as i from (select distinct def_id, text, regexp_extract_all(text, '\\b(\\d{1,4})\\b', 1) as v from footnote_defs where def_id is not null))), f as (select *, min(case when v = least then ord end) over (partition by def_id, text) as start from (select *, min(v) over (partition by def_id, text) as least from m)) select def_id, ord, v from (select *, max(v) over (partition by def_id, text order by ord rows between unbounded preceding and 1 preceding) as before from f where ord >= start) where before is null or v > before",
    "first_seen": "select dialogue_id, speaker, row_number() over (partition by dialogue_id order by min(line_no), speaker) as rank from new_turns where speaker is not null and line_no is not null and dialogue_id is not null group by dialogue_id, speaker",
    "title_order": f"select work_id, row_number() over (order by {_TITLES}, starts_with(title, 'On the Seeds') desc, title, work_id) as rank from works",
    "outlier_rank": "select o_orderkey, z from (select o_orderkey, round((o_totalprice - avg(o_totalprice) over w) / nullif(stddev_pop(o_totalprice) over w, 0), 3) as z from orders window w as (partition by o_orderpriority)) order by abs(z) desc, o_orderkey limit 20",
    "live_over_seed": "select work_id, coalesce(live, title) as value, row_number() over (order by ord nulls last, work_id) as rank from (select coalesce(s.work_id, l.work_id) as work_id, title, live, ord from (select work_id, title, row_number() over (order by released_at, work_id) as ord from works) s full join (select work_id, cast(max(doc_id) as varchar) as live from documents where work_id is not null and doc_kind = 'translation' group by work_id) l on s.work_id = l.work_id)",
    "key_samples": f"select lower(w) as key, count(*) as n, min(sent_id) as first_sent, bool_or(regexp_matches(w, '^[A-Z]')) as capital from (select sent_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) as w from {_GG.format(c='sent_id, lang, text')} where lang = 'lat') group by 1",
    "work_tree": f"select work_id, '[' || string_agg('{{\"book\":' || book || ',\"n\":' || n || '}}', ',' order by book) || ']' as books from (select work_id, book, count(*) as n from {_CC.format(c='chapter_id, work_id, book')} where work_id is not null and book is not null group by all) group by work_id",
    "facet_options": "select facet, value, row_number() over (partition by facet order by min(work_id)) as rank from (select 'lang' as facet, lang as value, work_id from works union all select 'scheme', scheme, work_id from works) where value is not null group by facet, value",
    "hits_by_level": f"select work_id, chapter_id, count(distinct w) as words, min(sent_id) as lo, max(sent_id) as hi from (select sent_id, work_id, chapter_id, unnest(regexp_extract_all(lower(text), '([a-z'']+)', 1)) as w from {_GG.format(c='sent_id, work_id, chapter_id, lang, text')} where lang = 'lat' and work_id is not null) where w in (select lower(form) from analyses where lang = 'lat' and length(form) >= 6) group by all",
    "entries_in_order": "select form, lang, entry, row_number() over (partition by form, lang order by min((lemma, i)), entry) as rank from (select form, lang, lemma, unnest(lsj) as entry, unnest(range(len(lsj))) as i from analyses) group by form, lang, entry",
    "nearest_translated": f"select chapter_id, translated from (select chapter_id, ross_text, max(case when ross_text is not null then chapter_id end) over (partition by work_id order by chapter_id rows between unbounded preceding and 1 preceding) as translated from {_CC.format(c='chapter_id, work_id, ross_text')} where work_id is not null) where ross_text is null",
    "elided_words": f"select distinct w, lower(form) as form from (select distinct unnest(regexp_extract_all(lower(text), '([a-z'']+)', 1)) as w from gsents where lang = 'lat' and sent_id is not null) join analyses on lang = 'lat' and length(form) > 4 and starts_with(lower(form), w) and length(form) - length(w) in (1, 2)",
    "cross_work": f"with f as (select distinct work_id, column_key, coalesce(length(text), 0) > 0 as filled from fragments where work_id is not null and column_key is not null) select distinct f.work_id, f.column_key, case when lo <> f.work_id then lo when hi <> f.work_id then hi end as from_work from f join (select column_key, min(work_id) as lo, max(work_id) as hi from f where filled group by column_key) b using (column_key) where not filled and (lo <> f.work_id or hi <> f.work_id)",
    "stop_lemmas": "select lang, lemma from analyses group by lang, lemma having not bool_and(regexp_matches(coalesce(parse, ''), '\\b(?:conj|particle|prep|article)\\b') or starts_with(coalesce(parse, ''), 'phrase'))",
    "marker_positions": "select cast(sum(len(regexp_extract_all(text, '\\d+'))) as bigint) as numbers, cast(sum(len(regexp_extract_all(text, '(?:^|[.·;\\]][)\\]’”»''\"]*)\\s*\\d+'))) as bigint) as markers from (select distinct text from footnote_defs where def_id is not null and text is not null)",
    "state_filter": f"select view, count(*) as n from (select unnest(list_filter([case when kind in ('verbatim', 'paraphrase') then 'active' end, case when kind in ('verbatim', 'paraphrase', 'conflict') then 'with drafts' end], lambda x: x is not null)) as view from (select distinct frag_id, kind from fragments where frag_id is not null)) group by view",
    "citable_lines": f"select work_id, count(*) as n from (select distinct work_id, unnest(lines) as l from {_GG.format(c='sent_id, work_id, lines')} where work_id is not null) where try_cast(nullif(regexp_extract(l, '([0-9]+)$', 1), '') as bigint) > 0 group by work_id",
}
QUERIES = {f.__name__: f for f in (section_gaps, section_spine, book_partition, book_gaps, anchors_ordered, keys_analysed, lines_ascend, fragment_kinds, fragment_order, public_gate, contract_errors, registry_agreement, address_baseline, inventory_hashes, release_complete, navigation_unique, acceptance, round_trip, page_advance, step_back, marker_accept, first_seen, title_order, outlier_rank, live_over_seed, shape_diff, key_samples, work_tree, facet_options, hits_by_level, entries_in_order, nearest_translated, elided_words, cross_work, stop_lemmas, marker_positions, state_filter, citable_lines)}
