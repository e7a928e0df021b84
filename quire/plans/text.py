"""Normalisation, tokens and inventories over the documents and lexicon tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import index, sequence, stats
from quire.sources.tables import read


def fold_latin(s, d):
    return read(s, d, "documents").select("doc_id", T.fold(F.col("text")).alias("folded"))


def tok_freq(s, d):
    return index.postings(read(s, d, "documents"), "doc_id", "text").groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("seg").alias("docs"))


def post_build(s, d):
    return index.postings(read(s, d, "documents"), "doc_id", "text").select("seg", F.col("pos").cast("long").alias("pos"), "term")


def char_inventory(s, d):
    return stats.char_inventory(read(s, d, "documents"), "text", r"A-Za-z0-9 .,;:!?'\n\r\-")


def hash_keys(s, d):
    return read(s, d, "documents").where("text is not null").select("doc_id", T.hash_key(F.col("text")).alias("key"))


def slugs(s, d):
    works = read(s, d, "works").withColumn("slug", T.slug(F.substring_index("title", " ", 3)))
    return sequence.unique_names(works, "slug", [F.col("work_id")]).select("work_id", "slug", F.col("unique_name").alias("unique_slug"))


def script_runs(s, d):
    runs = F.explode(F.regexp_extract_all("text", F.lit(r"[\p{IsGreek}]+"), F.lit(0)))
    return read(s, d, "gsents").select(runs.alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("n"))


def letters_key(s, d):
    return read(s, d, "analyses").select("form", "lang", T.letters_only(F.col("form")).alias("key"))


def beta_keys(s, d):
    return read(s, d, "analyses").where("lang = 'grc'").select("form", T.beta(F.col("form")).alias("key"))


def roman_values(s, d):
    n = read(s, d, "documents").select(F.explode(T.words(F.col("text"))).alias("numeral")).where("numeral rlike '^[ivxlc]+$'")
    return n.groupBy("numeral").agg(F.count(F.lit(1)).alias("n")).withColumn("value", T.roman(F.col("numeral")).cast("long"))


def collapse_trim(s, d):
    return read(s, d, "documents").where("text is not null").select("doc_id", T.collapse(F.col("text")).alias("collapsed"), T.trim_punct(F.substring_index(T.collapse(F.col("text")), " ", 1)).alias("first_word"))


def cite_numbers(s, d):
    """Leading number and letter suffix of citations such as 219d."""
    c = read(s, d, "chapter_refs").where("citation is not null")
    return c.select("chapter_id", F.expr("try_cast(nullif(regexp_extract(citation, '^([0-9]+)', 1), '') as bigint)").alias("num"), F.regexp_extract("citation", "^[0-9]+([a-z]*)", 1).alias("suffix")).distinct()


def line_heal(s, d):
    lines = read(s, d, "footnote_defs").where("text is not null").select("def_id", F.posexplode(F.split(F.regexp_replace("text", "\r", ""), "\n")).alias("ord", "line")).distinct()
    return sequence.rejoin_hyphens(lines, ["def_id"], "ord", "line").select("def_id", F.col("ord").cast("long").alias("ord"), "healed")


_WORDS = r"regexp_extract_all(lower(text), '([a-z'']+)', 1)"
POSTINGS = f"(select doc_id as seg, unnest(w) as term, generate_subscripts(w, 1) - 1 as pos from (select doc_id, {_WORDS} as w from documents))"
_FOLD = "replace(replace(strip_accents(replace(replace(lower(text), 'æ', 'ae'), 'œ', 'oe')), 'v', 'u'), 'j', 'i')"
_LINES = r"(select distinct def_id, unnest(l) as line, generate_subscripts(l, 1) - 1 as ord from (select def_id, string_split(replace(text, chr(13), ''), chr(10)) as l from footnote_defs where text is not null))"
_BETA = "translate(strip_accents(lower(form)), 'αβγδεζηθικλμνξοπρσςτυφχψω', 'abgdezhqiklmncoprsstufxyw')"
_ROMAN = "list_sum(list_transform(generate_series(1, length(numeral)), lambda i: case when {v0} < {v1} then -{v0} else {v0} end))".format(
    v0="map {'i': 1, 'v': 5, 'x': 10, 'l': 50, 'c': 100}[numeral[i]]", v1="coalesce(map {'i': 1, 'v': 5, 'x': 10, 'l': 50, 'c': 100}[nullif(numeral[i + 1], '')], 0)"
)

SQL = {
    "fold_latin": f"select doc_id, {_FOLD} as folded from documents",
    "tok_freq": f"select term, count(*) as n, count(distinct seg) as docs from {POSTINGS} group by term",
    "post_build": f"select seg, pos, term from {POSTINGS}",
    "char_inventory": r"select ch, count(*) as n from (select unnest(regexp_extract_all(text, '[^A-Za-z0-9 .,;:!?''\n\r\-]', 0)) as ch from documents) group by ch",
    "hash_keys": "select doc_id, left(sha256(text), 16) as key from documents where text is not null",
    "slugs": r"with w as (select work_id, trim(regexp_replace(strip_accents(lower(array_to_string(string_split(title, ' ')[1:3], ' '))), '[^a-z0-9]+', '-', 'g'), '-') as slug from works), r as (select *, row_number() over (partition by slug order by work_id) as n from w) select work_id, slug, case when n = 1 then slug else slug || '-' || n end as unique_slug from r",
    "script_runs": r"select run, count(*) as n from (select unnest(regexp_extract_all(text, '[\p{Greek}]+', 0)) as run from gsents) group by run",
    "letters_key": r"select form, lang, regexp_replace(replace(strip_accents(lower(form)), 'ς', 'σ'), '[^\p{L}]+', '', 'g') as key from analyses",
    "beta_keys": f"select form, {_BETA} as key from analyses where lang = 'grc'",
    "roman_values": rf"select numeral, count(*) as n, cast({_ROMAN} as bigint) as value from (select unnest({_WORDS}) as numeral from documents) where regexp_matches(numeral, '^[ivxlc]+$') group by numeral",
    "collapse_trim": r"select doc_id, c as collapsed, regexp_replace(string_split(c, ' ')[1], '^[\s\p{P}]+|[\s\p{P}]+$', '', 'g') as first_word from (select doc_id, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ +| +$', '', 'g') as c from documents where text is not null)",
    "cite_numbers": "select distinct chapter_id, try_cast(nullif(regexp_extract(citation, '^([0-9]+)', 1), '') as bigint) as num, regexp_extract(citation, '^[0-9]+([a-z]*)', 1) as suffix from chapter_refs where citation is not null",
    "line_heal": rf"""with l as (select *, regexp_matches(line, '[A-Za-z]-$') as parted from {_LINES}),
        n as (select *, lead(line) over w as nxt, coalesce(lag(parted) over w, false) as took from l window w as (partition by def_id order by ord)),
        r as (select *, case when not took then line when position(' ' in line) > 0 then substring(line, position(' ' in line) + 1) else '' end as rest from n)
        select def_id, ord, case when parted and nxt is not null then regexp_replace(rest, '-$', '') || string_split(nxt, ' ')[1] else rest end as healed from r""",
}
QUERIES = {f.__name__: f for f in (fold_latin, tok_freq, post_build, char_inventory, hash_keys, slugs, script_runs, letters_key, beta_keys, roman_values, collapse_trim, cite_numbers, line_heal)}
