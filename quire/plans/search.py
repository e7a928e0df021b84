"""Searches over the documents' index."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import index, stats
from quire.plans.text import POSTINGS
from quire.sources.tables import read


def _index(s, d):
    return index.postings(read(s, d, "documents"), "doc_id", "text")


def search_all(s, d):
    return index.search_all(_index(s, d), ["general", "river", "summer"])


def search_any(s, d):
    return index.search_any(_index(s, d), ["constellation", "papyrus"])


def search_prefix(s, d):
    return index.search_all(_index(s, d), ["gram*", "want*"])


def search_phrase(s, d):
    return index.search_phrase(_index(s, d), ["in", "the", "market"]).select("seg", F.col("pos").cast("long").alias("pos"))


def search_and_or(s, d):
    """Segments with every term of one list, or any of the other that also hold a common term."""
    i = _index(s, d)
    a = index.search_all(i, ["soldier", "oath"])
    b = index.search_any(i, ["proverb"]).join(index.search_any(i, ["grief"]), "seg", "left_semi")
    return a.union(b).distinct()


def hit_positions(s, d):
    return index.hit_positions(_index(s, d), ["harbour", "island"]).select("seg", "n", F.array_join("positions", ",").alias("positions"))


def kwic_phrase(s, d):
    return index.kwic(read(s, d, "documents"), "doc_id", "text", ["in", "the", "market"]).withColumn("pos", F.col("pos").cast("long"))


def kwic_chars(s, d):
    return index.kwic_chars(read(s, d, "documents"), "doc_id", "text", "in the garden").withColumn("at", F.col("at").cast("long"))


def term_rollup(s, d):
    docs = read(s, d, "documents").withColumn("owner", F.coalesce("source", F.lit("?")))
    return index.rollup_terms(index.postings(docs, "doc_id", "text", ["owner"]))


def top_terms(s, d):
    docs = read(s, d, "documents").withColumn("source", F.coalesce("source", F.lit("?")))
    n = index.postings(docs, "doc_id", "text", ["source"]).groupBy("source", "term").agg(F.count(F.lit(1)).alias("n"))
    return stats.top_k(n, ["source"], [F.col("n").desc(), F.col("term")], 5).select("source", "term", "n", F.col("rank").cast("long").alias("rank"))


def palette(s, d):
    """Ranked suggestion of works for a typed string: exact, title prefix, word start, id prefix, within; the six best."""
    q = "on the lamps"
    t = F.lower("title")
    tier = F.when(t == q, 0).when(t.startswith(q), 1).when(F.contains(t, F.lit(" " + q)), 2).when(F.col("work_id").startswith(q), 3).when(F.contains(t, F.lit(q)), 4)
    return read(s, d, "works").select("work_id", "title", tier.cast("long").alias("tier")).where("tier is not null").orderBy("tier", "title", "work_id").limit(6)


def tfidf_weights(s, d):
    return stats.tfidf(_index(s, d)).select("seg", "term", F.round("w", 4).alias("w"))


_DOCS = "(select doc_id as seg, coalesce(source, '?') as owner from documents)"
_PHRASE = f"(select a.seg, a.pos from {POSTINGS} a join {POSTINGS} b on a.seg = b.seg and b.pos = a.pos + 1 join {POSTINGS} c on a.seg = c.seg and c.pos = a.pos + 2 where a.term = 'in' and b.term = 'the' and c.term = 'market')"
SQL = {
    "search_all": f"select seg from {POSTINGS} where term in ('general', 'river', 'summer') group by seg having count(distinct term) = 3",
    "search_any": f"select distinct seg from {POSTINGS} where term in ('constellation', 'papyrus')",
    "search_prefix": f"select seg from {POSTINGS} group by seg having bool_or(term like 'gram%') and bool_or(term like 'want%')",
    "search_phrase": f"select seg, pos from {_PHRASE}",
    "search_and_or": f"select seg from {POSTINGS} where term in ('soldier', 'oath') group by seg having count(distinct term) = 2 union select seg from {POSTINGS} where term in ('proverb', 'grief') group by seg having count(distinct term) = 2",
    "hit_positions": f"select seg, count(*) as n, string_agg(cast(pos as varchar), ',' order by pos) as positions from {POSTINGS} where term in ('harbour', 'island') group by seg",
    "kwic_phrase": f"select p.seg, p.pos, array_to_string(w[greatest(1, p.pos - 7):p.pos], ' ') as \"left\", array_to_string(w[p.pos + 1:p.pos + 3], ' ') as hit, array_to_string(w[p.pos + 4:p.pos + 11], ' ') as \"right\" from {_PHRASE} p join (select doc_id as seg, regexp_extract_all(lower(text), '([a-z'']+)', 1) as w from documents) t on p.seg = t.seg",
    "kwic_chars": "select doc_id as seg, p as \"at\", substring(text, greatest(1, p - 40), p + 53 - greatest(1, p - 40)) as snippet from (select *, position('in the garden' in text) as p from documents) where p > 0",
    "term_rollup": f"select term, owner, count(*) as n from {POSTINGS} join {_DOCS} using (seg) group by grouping sets ((term, owner), (term)) having count(*) >= 3",
    "top_terms": f"select source, term, n, rank from (select owner as source, term, count(*) as n, row_number() over (partition by owner order by count(*) desc, term) as rank from {POSTINGS} join {_DOCS} using (seg) group by owner, term) where rank <= 5",
    "palette": "select work_id, title, tier from (select work_id, title, case when lower(title) = 'on the lamps' then 0 when starts_with(lower(title), 'on the lamps') then 1 when contains(lower(title), ' on the lamps') then 2 when starts_with(work_id, 'on the lamps') then 3 when contains(lower(title), 'on the lamps') then 4 end as tier from works) where tier is not null order by tier, title, work_id limit 6",
    "tfidf_weights": f"with p as (select * from {POSTINGS}), tf as (select seg, term, count(*) as c from p group by all), sz as (select seg, count(*) as len from p group by seg), df as (select term, count(*) as df from tf group by term), t as (select count(*) as total from sz), w as (select seg, term, c / len * (ln((total + 1) / (df + 1)) + 1) as w from tf join sz using (seg) join df using (term), t) select seg, term, round(w / sqrt(sum(w * w) over (partition by seg)), 4) as w from w",
}
QUERIES = {f.__name__: f for f in (kwic_phrase, search_all, search_any, search_prefix, search_phrase, search_and_or, hit_positions, kwic_chars, term_rollup, top_terms, palette, tfidf_weights)}
