"""Offsets, shingles, order checks, reports and outlines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import align, cite
from quire.sources.tables import read


def _pieces(df, key: str, text, pattern: str):
    """(key, ord, off, piece): consecutive pieces of a text with their 0-based offsets."""
    p = df.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("ord", "piece"))
    w = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return p.withColumn("off", F.coalesce(F.sum(F.length("piece")).over(w), F.lit(0)))


def tok_offsets(s, d):
    """Every English word with its offset in the text."""
    p = _pieces(read(s, d, "documents"), "doc_id", F.lower("text"), r"[a-z']+|[^a-z']+")
    return p.where(F.col("piece").rlike("^[a-z']")).select("doc_id", "off", F.col("piece").alias("tok"))


def sentence_offsets(s, d):
    """Pieces that end in full stops, with their offsets (the plain split; see the unsupervised one for boundaries)."""
    return _pieces(read(s, d, "footnote_defs").select("def_id", "text").distinct(), "def_id", F.col("text"), r"[^.!?]*[.!?]+|[^.!?]+$").select("def_id", "off", "piece")


def shingles(s, d):
    """Three-word shingles seen in two documents or more."""
    w = read(s, d, "documents").select("doc_id", T.words(F.col("text")).alias("w")).where("size(w) > 2")
    sh = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.array_join(F.slice("w", i + 1, 3), " "))
    return w.select("doc_id", F.explode(F.array_distinct(sh)).alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("docs")).where("docs > 1")


def year_mentions(s, d):
    y = F.explode(F.regexp_extract_all("text", F.lit(r"\byear ([0-9]{1,3})\b"), F.lit(1)))
    return read(s, d, "documents").select(y.alias("y")).groupBy(F.col("y").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("n"))


def roster(s, d):
    p = read(s, d, "speakers")
    return p.groupBy("dialogue_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("speaker")), "; ").alias("names"))


def unmatched(s, d):
    """Chapters without sentences, and sentences whose chapter is not listed: a full join's two ends."""
    c = read(s, d, "chapter_refs").select("chapter_id").distinct().withColumn("c", F.lit(1))
    g = read(s, d, "gsents").where("chapter_id is not null").groupBy("chapter_id").agg(F.countDistinct("sent_id").alias("n"))
    return c.join(g, "chapter_id", "full").select("chapter_id", F.coalesce("n", F.lit(0)).alias("sents"), F.when(F.col("n").isNull(), "no sentence").when(F.col("c").isNull(), "not listed").otherwise("matched").alias("state"))


def monotone_check(s, d):
    """Whether the spans of each chapter ascend strictly."""
    g = read(s, d, "gsents").where("span_start is not null").select("chapter_id", "sent_id", "seq", "span_start").distinct()
    up = F.coalesce(F.col("span_start") > F.lag("span_start").over(Window.partitionBy("chapter_id").orderBy("seq", "sent_id")), F.lit(True))
    return g.withColumn("up", up).groupBy("chapter_id").agg(F.min("up").alias("ascending"))


def note_numbers(s, d):
    f = read(s, d, "footnote_defs").select("def_id", "work_id", "line_no").distinct()
    return f.select("def_id", F.row_number().over(Window.partitionBy("work_id").orderBy("line_no", "def_id")).cast("long").alias("number"))


def book_starts(s, d):
    c = read(s, d, "chapter_refs").select("work_id", "book", "chapter_id").distinct()
    first = F.row_number().over(Window.partitionBy("work_id", "book").orderBy("chapter_id")) == 1
    return c.select("chapter_id", first.alias("starts_book"))


def catalog_counts(s, d):
    return read(s, d, "works").groupBy("lang", "scheme").agg(F.count(F.lit(1)).alias("works"), F.countDistinct("author").alias("authors"), F.sum("n_books").alias("books"))


def broken_mentions(s, d):
    """Titles that notes refer to and no work has."""
    m = read(s, d, "footnote_defs").select("def_id", "text").distinct().select("def_id", F.regexp_extract(F.regexp_replace("text", r"\s+", " "), r"^See (On the [A-Z][a-z]+ of [A-Z][a-z]+)", 1).alias("title")).where("title <> ''")
    return m.join(read(s, d, "works").select("title").distinct(), "title", "left_anti").select("def_id", "title")


def cite_labels(s, d):
    c = read(s, d, "chapter_refs").where("citation is not null").select("chapter_id", "work_id", "book", "citation").distinct()
    return c.join(read(s, d, "works").select("work_id", "author", "title"), "work_id").select("chapter_id", F.format_string("%s, %s %d, %s", "author", "title", "book", "citation").alias("label"))


def cite_order(s, d):
    """Place of each citation within its work by the scheme's own order."""
    c = read(s, d, "chapter_refs").where("citation is not null").select("work_id", "citation").distinct()
    k = cite.sort_key(F.col("citation"))
    w = Window.partitionBy("work_id").orderBy(k, "citation")
    return c.select("work_id", "citation", F.row_number().over(w).cast("long").alias("place"))


def gate_report(s, d):
    """How a review gate on the length ratio of translations would work: caught, passed, and share."""
    c = read(s, d, "chapter_refs").where("length(ross_text) > 0 and length(ref_text) > 0").select("chapter_id", "ref_lang", (F.length("ref_text") / F.length("ross_text")).alias("r")).distinct()
    gate = (F.col("r") < 0.7) | (F.col("r") > 1.4)
    return c.groupBy("ref_lang").agg(F.count(F.lit(1)).alias("n"), F.sum(gate.cast("long")).alias("caught"), F.round(F.avg(gate.cast("double")), 4).alias("share"))


def sound_levels(s, d):
    """Prominence of turns: dense rank of the length of a dialogue's printed turns, at most 5."""
    t = read(s, d, "ref_turns").where("text is not null").select("ref_id", "dialogue_id", F.length("text").alias("len")).distinct()
    return t.select("ref_id", F.least(F.lit(5), F.dense_rank().over(Window.partitionBy("dialogue_id").orderBy(F.col("len").desc()))).cast("long").alias("level"))


def beta_round(s, d):
    """Forms by way of Beta Code and back: letters without accents, final sigma restored."""
    a = read(s, d, "analyses").where("lang = 'grc' and form is not null").select("form").distinct()
    return a.select("form", T.greek_from_beta(T.beta(F.col("form"))).alias("plain"))


def chained_refs(s, d):
    """Numbers of a note with the series letter in force: named once, it holds until the next."""
    f = read(s, d, "footnote_defs").select("def_id", "text").distinct()
    m = F.arrays_zip(*[F.regexp_extract_all("text", F.lit(r"\b([A-Z]?)([0-9]+)\b"), F.lit(k)).alias(n) for k, n in ((1, "letter"), (2, "number"))])
    x = f.select("def_id", F.posexplode(m).alias("ord", "m")).select("def_id", "ord", F.nullif(F.col("m.letter"), F.lit("")).alias("letter"), F.col("m.number").alias("number"))
    held = F.last("letter", ignorenulls=True).over(Window.partitionBy("def_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    return x.select("def_id", F.col("ord").cast("long").alias("ord"), held.alias("series"), "number")


def diff_hunks(s, d):
    """Where a correction changes the words: the runs of words that differ on both sides."""
    c = read(s, d, "corrections").select("corr_id", "find", "replace").distinct().where("find is not null and replace is not null")
    return align.hunks(c, "corr_id", "find", "replace")


_W = r"regexp_extract_all(lower(text), '([a-z'']+)', 1)"
_OFF = "coalesce(sum(length(piece)) over (partition by {k} order by ord rows between unbounded preceding and 1 preceding), 0)"
_KEY = r"case when regexp_matches(x, '^([AB])\s?(\d+)') then regexp_extract(x, '^([AB])', 1) else '' end, cast(regexp_extract(x, '(\d+)', 1) as bigint), case when regexp_matches(x, '^(\d+)([a-e])(?:\.?(\d+))?$') then regexp_extract(x, '^\d+([a-e])', 1) when regexp_matches(x, '^(\d+)\.(\d+)') then lpad(regexp_extract(x, '^\d+\.(\d+)', 1), 9, '0') else '' end"
SQL = {
    "beta_round": r"select distinct form, regexp_replace(replace(strip_accents(lower(form)), 'ς', 'σ'), 'σ($|[^\p{Greek}])', 'ς\1', 'g') as plain from analyses where lang = 'grc' and form is not null",
    "chained_refs": r"select def_id, ord, last_value(letter ignore nulls) over (partition by def_id order by ord rows between unbounded preceding and current row) as series, number from (select def_id, nullif(unnest(a), '') as letter, unnest(b) as number, generate_subscripts(a, 1) - 1 as ord from (select def_id, regexp_extract_all(text, '\b([A-Z]?)([0-9]+)\b', 1) as a, regexp_extract_all(text, '\b([A-Z]?)([0-9]+)\b', 2) as b from (select distinct def_id, text from footnote_defs)))",
    "tok_offsets": rf"select doc_id, cast(off as bigint) as off, piece as tok from (select *, {_OFF.format(k='doc_id')} as off from (select doc_id, unnest(p) as piece, generate_subscripts(p, 1) as ord from (select doc_id, regexp_extract_all(lower(text), '[a-z'']+|[^a-z'']+', 0) as p from documents))) where regexp_matches(piece, '^[a-z'']')",
    "sentence_offsets": rf"select def_id, cast({_OFF.format(k='def_id')} as bigint) as off, piece from (select def_id, unnest(p) as piece, generate_subscripts(p, 1) as ord from (select def_id, regexp_extract_all(text, '[^.!?]*[.!?]+|[^.!?]+$', 0) as p from (select distinct def_id, text from footnote_defs)))",
    "shingles": f"with w as (select doc_id, {_W} as w from documents) select shingle, count(*) as docs from (select distinct doc_id, array_to_string(w[i:i + 2], ' ') as shingle from (select doc_id, w, unnest(generate_series(1, len(w) - 2)) as i from w where len(w) > 2)) group by shingle having count(*) > 1",
    "year_mentions": r"select cast(y as bigint) as year, count(*) as n from (select unnest(regexp_extract_all(text, '\byear ([0-9]{1,3})\b', 1)) as y from documents) group by 1",
    "roster": "select dialogue_id, count(*) as n, string_agg(distinct speaker, '; ' order by speaker) as names from speakers group by dialogue_id",
    "unmatched": "select coalesce(c.chapter_id, g.chapter_id) as chapter_id, coalesce(n, 0) as sents, case when n is null then 'no sentence' when c.chapter_id is null then 'not listed' else 'matched' end as state from (select distinct chapter_id from chapter_refs) c full join (select chapter_id, count(distinct sent_id) as n from gsents where chapter_id is not null group by chapter_id) g on c.chapter_id = g.chapter_id",
    "monotone_check": "select chapter_id, bool_and(up) as ascending from (select chapter_id, coalesce(span_start > lag(span_start) over (partition by chapter_id order by seq, sent_id), true) as up from (select distinct chapter_id, sent_id, seq, span_start from gsents where span_start is not null)) group by chapter_id",
    "note_numbers": "select def_id, row_number() over (partition by work_id order by line_no nulls first, def_id) as number from (select distinct def_id, work_id, line_no from footnote_defs)",
    "book_starts": "select chapter_id, row_number() over (partition by work_id, book order by chapter_id) = 1 as starts_book from (select distinct work_id, book, chapter_id from chapter_refs)",
    "catalog_counts": "select lang, scheme, count(*) as works, count(distinct author) as authors, cast(sum(n_books) as bigint) as books from works group by lang, scheme",
    "broken_mentions": r"select def_id, title from (select def_id, regexp_extract(regexp_replace(text, '\s+', ' ', 'g'), '^See (On the [A-Z][a-z]+ of [A-Z][a-z]+)', 1) as title from (select distinct def_id, text from footnote_defs)) where title <> '' and title not in (select title from works where title is not null)",
    "cite_labels": "select chapter_id, author || ', ' || title || ' ' || book || ', ' || citation as label from (select distinct chapter_id, work_id, book, citation from chapter_refs where citation is not null) join (select work_id, author, title from works) using (work_id)",
    "cite_order": f"select work_id, x as citation, row_number() over (partition by work_id order by {_KEY}, x) as place from (select distinct work_id, citation as x from chapter_refs where citation is not null)",
    "gate_report": "select ref_lang, count(*) as n, cast(sum(case when r < 0.7 or r > 1.4 then 1 else 0 end) as bigint) as caught, round(avg(case when r < 0.7 or r > 1.4 then 1.0 else 0.0 end), 4) as share from (select distinct chapter_id, ref_lang, length(ref_text) / length(ross_text) as r from chapter_refs where length(ross_text) > 0 and length(ref_text) > 0) group by ref_lang",
    "sound_levels": "select ref_id, least(5, dense_rank() over (partition by dialogue_id order by len desc)) as level from (select distinct ref_id, dialogue_id, length(text) as len from ref_turns where text is not null)",
}
QUERIES = {f.__name__: f for f in (tok_offsets, sentence_offsets, shingles, year_mentions, roster, unmatched, monotone_check, note_numbers, book_starts, catalog_counts, broken_mentions, cite_labels, cite_order, gate_report, sound_levels, beta_round, chained_refs, diff_hunks)}
