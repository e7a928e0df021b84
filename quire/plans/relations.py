"""Joins, ordered rows, statistics and merges over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.operators import joins, merge, sequence, stats
from quire.sources.tables import read


def asof_event(s, d):
    """Each purchase with the user's last view at or before it."""
    e = read(s, d, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    return joins.asof(left, right, ["user_id"], "ts", "view_id", F.col("view_id")).select("event_id", "user_id", F.col("asof_view_id").alias("view_id"))


def asof_citation(s, d):
    """Each anchor of a translation with the nearest original line at or before its relative place."""
    c = read(s, d, "chapter_refs").where("ref_text is not null").select("chapter_id", "ref_anchors", "greek_lines", "ref_text").dropDuplicates(["chapter_id"])
    words = F.element_at("greek_lines", -1)["cum_words"]
    a = c.select("chapter_id", words.alias("w"), F.length("ref_text").alias("len"), F.explode("ref_anchors").alias("a"))
    a = a.select("chapter_id", F.col("a.citation").alias("anchor"), F.floor(F.col("a.off") * F.col("w") / F.col("len")).cast("int").alias("at"))
    lines = c.select("chapter_id", F.explode("greek_lines").alias("l")).select("chapter_id", F.col("l.cum_words").alias("at"), F.col("l.citation").alias("line"))
    return joins.asof(a, lines, ["chapter_id"], "at", "line").select("chapter_id", "anchor", F.col("at").cast("long").alias("at"), F.col("asof_line").alias("line"))


def point_in_range(s, d):
    """Order totals in the balance range of the customers of one segment and nation."""
    p = read(s, d, "orders").select("o_orderkey", F.floor("o_totalprice").cast("long").alias("price"))
    spans = read(s, d, "part").select("p_partkey", (F.col("p_partkey") * 200).alias("lo"), (F.col("p_partkey") * 200 + 99).alias("hi"))
    return joins.contains(p, "price", spans, "lo", "hi", 1000).select("o_orderkey", "p_partkey")


def nearest_range(s, d):
    pts = read(s, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.floor("c_acctbal").cast("long").alias("at"))
    spans = read(s, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.floor("s_acctbal").cast("long").alias("lo"), (F.floor("s_acctbal") + 500).cast("long").alias("hi"), "s_suppkey")
    return joins.nearest(pts, ["nation"], "at", spans, "lo", "hi", "s_suppkey", "s_suppkey", 500).select("c_custkey", "s_suppkey", "distance")


def ranked_lookup(s, d):
    """Words of the original in the lexicon: as written, in lower case, or without a final period."""
    w = read(s, d, "gsents").select(F.explode(F.split("text", r"\s+")).alias("word")).where("word <> ''").distinct()
    a = read(s, d, "analyses").where("lemma is not null").select("form", "lemma")
    c = F.col("word")
    return joins.ranked_lookup(w, "word", [c, F.lower(c), F.regexp_replace(c, r"[.,;]+$", "")], a, "form", "lemma").select("word", "lemma", F.col("rank").cast("long").alias("rank"))


def semi_needed(s, d):
    lex = read(s, d, "analyses").select("form", "lang").distinct()
    need = read(s, d, "gsents").select(F.explode(F.split("text", r"\s+")).alias("form")).distinct()
    return lex.join(need, "form", "left_semi")


def reconcile_works(s, d):
    docs = read(s, d, "documents").select("work_id")
    refs = read(s, d, "chapter_refs").select("work_id")
    allowed = read(s, d, "works").where("lang = 'en'").select("work_id")
    return joins.reconcile(docs, refs, "work_id", allowed)


def range_expand(s, d):
    w = read(s, d, "works").select("work_id", F.lit(1).alias("lo"), "n_books")
    return joins.expand(w, "lo", "n_books", "book").select("work_id", F.col("book").cast("long").alias("book"))


def span_slices(s, d):
    """The sentences cut from each translation by their offsets."""
    c = read(s, d, "chapter_refs").select("ross_text", F.explode("ross_sents").alias("x"))
    return c.select(F.col("x.sent_id").alias("sent_id"), F.substring("ross_text", F.col("x.off_start") + 1, F.col("x.off_end") - F.col("x.off_start")).alias("sentence")).distinct()


def line_gaps(s, d):
    return sequence.gaps(read(s, d, "ref_turns"), ["dialogue_id"], "turn_index").select("dialogue_id", F.col("after").cast("long").alias("after"), F.col("next").cast("long").alias("next"))


def transposed(s, d):
    """Documents that were added after ones written later, by source."""
    docs = read(s, d, "documents").where("written_at is not null and source is not null").select("source", "doc_id", "written_at")
    return sequence.out_of_order(docs, ["source"], ["doc_id"], "written_at").select("source", "doc_id")


def chapter_ranges(s, d):
    c = read(s, d, "chapter_refs").select("work_id", "book", "chapter_id").distinct().groupBy("work_id", "book").agg(F.min("chapter_id").alias("start"))
    return sequence.ranges(c, ["work_id"], "start", F.lit(999999999)).select("work_id", F.col("book").cast("long").alias("book"), "start", F.col("range_end").cast("long").alias("range_end"))


def label_suppress(s, d):
    t = read(s, d, "ref_turns").select("ref_id", "dialogue_id", "turn_index", "speaker").distinct()
    return sequence.carry(t, ["dialogue_id"], ["turn_index", "ref_id"], "speaker").select("ref_id", "held", "shown")


def speaker_runs(s, d):
    t = read(s, d, "ref_turns").select("ref_id", "dialogue_id", "turn_index", "speaker").distinct()
    r = sequence.islands(t, ["dialogue_id"], ["turn_index", "ref_id"], "speaker")
    return r.select("dialogue_id", "speaker", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "n")


def coverage_depth(s, d):
    sp = read(s, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_orderkey").alias("lo"), (F.col("l_orderkey") + 40).alias("hi"))
    return sequence.coverage(sp, ["k"], "lo", "hi").select("k", "at", F.col("depth").cast("long").alias("depth"))


def sessionise(s, d):
    e = read(s, d, "events").select("event_id", "user_id", "ts", "event_type")
    return sequence.sessions(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup").select("event_id", F.col("section").cast("long").alias("section"))


def cumulative_words(s, d):
    g = read(s, d, "gsents").select("chapter_id", "sent_id", "seq", "text").distinct()
    n = F.size(F.expr("filter(split(coalesce(text, ''), '[ \\n]+'), x -> x <> '')"))
    w = Window.partitionBy("chapter_id").orderBy("seq", "sent_id").rowsBetween(Window.unboundedPreceding, 0)
    return g.select("chapter_id", "sent_id", F.sum(n).over(w).alias("upto"))


def ratio_robust_z(s, d):
    c = read(s, d, "chapter_refs").where("length(ross_text) > 0 and length(ref_text) > 0").select("chapter_id", "ref_lang", F.log(F.length("ref_text") / F.length("ross_text")).alias("x")).distinct()
    return stats.robust_z(c, ["ref_lang"], "x").select("chapter_id", F.round("z", 4).alias("z"))


def ratio_outliers(s, d):
    o = read(s, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return stats.outliers(o, ["o_orderpriority"], "o_totalprice").select("o_orderkey")


def error_summary(s, d):
    li = read(s, d, "lineitem").select("l_returnflag", "l_quantity")
    return stats.summary(li, "l_returnflag", "l_quantity", F.col("l_quantity") == 1)


def mode_first_seen(s, d):
    t = read(s, d, "ref_turns").select("ref_id", "dialogue_id", "turn_index", "speaker").distinct()
    return stats.mode_first(t, ["dialogue_id"], "speaker", "ref_id")


def name_window(s, d):
    """Sentences and each name that a chapter neighbour holds as well."""
    names = F.array_distinct(F.regexp_extract_all("text", F.lit(r" ([A-Z][a-z]+)"), F.lit(1)))
    g = read(s, d, "gsents").where("lang = 'lat'").select("chapter_id", "sent_id", "seq", names.alias("names")).distinct()
    g = g.withColumn("pos", F.row_number().over(Window.partitionBy("chapter_id").orderBy("seq", "sent_id")))
    w = Window.partitionBy("chapter_id", "name").orderBy("pos")
    near = (F.col("pos") - F.lag("pos").over(w) == 1) | (F.lead("pos").over(w) - F.col("pos") == 1)
    return g.select("chapter_id", "sent_id", "pos", F.explode("names").alias("name")).withColumn("near", near).where("near").select("sent_id", "name")


def config_grid(s, d):
    g = read(s, d, "lineitem").groupBy("l_linestatus").pivot("l_returnflag", ["A", "N", "R"]).agg(F.round(F.avg("l_discount"), 4))
    return g.select("l_linestatus", *[F.col(x).alias(f"avg_{x.lower()}") for x in "ANR"])


def merge_existing_wins(s, d):
    a = read(s, d, "analyses").where("lang in ('grc', 'lat')").groupBy("form").agg(F.min("gloss").alias("gloss"))
    b = read(s, d, "analyses").groupBy("form").agg(F.max("gloss").alias("gloss"))
    return merge.merge(a, b, "form", "gloss", "old")


def tree_diff(s, d):
    """Each original as first sent against as last sent, all rows by content."""
    g = read(s, d, "gsents").where("sent_id is not null")
    h = F.md5(F.to_json(F.struct(*sorted(c for c in g.columns if c != "loaded_at")), {"ignoreNullFields": "false"}))
    g = g.select("sent_id", "loaded_at", h.alias("h"))
    # Of equal stamps the smaller content is the earlier.
    one = g.groupBy("sent_id").agg(F.min(F.struct("loaded_at", "h"))["h"].alias("h"))
    two = g.groupBy("sent_id").agg(F.max(F.struct("loaded_at", "h"))["h"].alias("h"))
    return merge.diff(one, two, "sent_id", "h")


def publish_decision(s, d):
    return merge.decision(tree_diff(s, d))


def revision_fold(s, d):
    e = read(s, d, "events").select("event_id", "user_id", "ts", F.floor("value").cast("long").alias("rev")).where("rev is not null")
    return merge.revisions(e, ["user_id"], ["ts", "event_id"], "rev").select("event_id", "outcome")


def port_text(s, d):
    """Fragments and where the text that they take by text_from comes from, along chains within a file."""
    f = read(s, d, "fragments").select("frag_id", "source_file", "column_key", "text_from").distinct()
    return merge.port(f, "frag_id", "source_file", "column_key", "text_from")


def facet_counts(s, d):
    w = read(s, d, "works")
    return w.groupingSets([[F.col("lang")], [F.col("scheme")], []], F.col("lang"), F.col("scheme")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("author").alias("authors"))


def catalog_model(s, d):
    """Region, nation and party counts as one table of levels."""
    n = read(s, d, "nation").join(F.broadcast(read(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    c = read(s, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    return n.join(c, F.col("n_nationkey") == F.col("k"), "left").rollup("r_name", "n_name").agg(F.coalesce(F.sum("customers"), F.lit(0)).alias("customers"))


def recent_docs(s, d):
    docs = read(s, d, "documents").where("work_id is not null").select("work_id", "doc_id", "added_at")
    return stats.top_k(docs, ["work_id"], [F.col("added_at").desc(), F.col("doc_id")], 3).select("work_id", "doc_id", F.col("rank").cast("long").alias("rank"))


def duplicates_casefold(s, d):
    return read(s, d, "new_turns").where("speaker is not null").groupBy(F.lower("speaker").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("dialogue_id").alias("dialogues")).where("n > 1")


def embedding_neighbours(s, d):
    """Queries (ids divisible by 50) against all vectors, by blocks: cosine of the best three."""
    e = read(s, d, "embeddings").select("vec_id", "embedding")
    best = stats.neighbours(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 3)
    return best.select("q", "vec_id", F.round("sim", 4).alias("sim"))


_REF = "(select distinct ref_id, dialogue_id, turn_index, speaker from ref_turns)"
_DIFF = "(select sent_id, case when arg_min(h, (loaded_at, h)) = arg_max(h, (loaded_at, h)) then 'identical' else 'changed' end as state from (select sent_id, loaded_at, md5(cast(to_json({'a': chapter_id, 'b': work_id, 'c': seq, 'd': lang, 'e': span_start, 'f': span_end, 'g': text, 'h': lines, 'i': ticks, 'j': w_start, 'k': w_end, 'l': gloss}) as varchar)) as h from gsents where sent_id is not null) group by sent_id)"
SQL = {
    "asof_event": "select p.event_id, p.user_id, (select arg_max(v.event_id, (v.ts, v.event_id)) from events v where v.event_type = 'view' and v.user_id = p.user_id and v.ts <= p.ts) as view_id from events p where event_type = 'purchase'",
    "asof_citation": "with c as (select distinct chapter_id, ref_text, ref_anchors, greek_lines from chapter_refs where ref_text is not null), a as (select chapter_id, x.citation as anchor, cast(floor(x.off * w / len) as bigint) as at_ from (select chapter_id, greek_lines[-1].cum_words as w, length(ref_text) as len, unnest(ref_anchors) as x from c)), l as (select chapter_id, y.cum_words as at_, y.citation as line from (select chapter_id, unnest(greek_lines) as y from c)) select a.chapter_id, a.anchor, a.at_ as \"at\", (select arg_max(l.line, l.at_) from l where l.chapter_id = a.chapter_id and l.at_ <= a.at_) as line from a",
    "point_in_range": "select o_orderkey, p_partkey from orders join part on cast(floor(o_totalprice) as bigint) between p_partkey * 200 and p_partkey * 200 + 99",
    "nearest_range": "select c_custkey, arg_min(s_suppkey, (d, s_suppkey)) as s_suppkey, min(d) as distance from (select c_custkey, s_suppkey, case when at_ < lo then lo - at_ when at_ > lo + 500 then at_ - lo - 500 else 0 end as d from (select c_custkey, c_nationkey, cast(floor(c_acctbal) as bigint) as at_ from customer) join (select s_suppkey, s_nationkey, cast(floor(s_acctbal) as bigint) as lo from supplier) on c_nationkey = s_nationkey) group by c_custkey",
    "ranked_lookup": r"with w as (select distinct word from (select unnest(regexp_split_to_array(text, '\s+')) as word from gsents) where word <> ''), c as (select word, 0 as rank, word as f from w union all select word, case when lower(word) = word then null else 1 end, lower(word) from w union all select word, case when regexp_replace(word, '[.,;]+$', '') = word or regexp_replace(word, '[.,;]+$', '') = lower(word) then null when lower(word) = word then 1 else 2 end, regexp_replace(word, '[.,;]+$', '') from w), h as (select word, rank, min(lemma) as lemma from c join analyses on f = form and lemma is not null where rank is not null group by word, rank) select word, arg_min(lemma, rank) as lemma, cast(min(rank) as bigint) as rank from h group by word",
    "semi_needed": r"select distinct form, lang from analyses where form in (select unnest(regexp_split_to_array(text, '\s+')) from gsents)",
    "reconcile_works": "with l as (select distinct work_id from documents where work_id is not null), r as (select distinct work_id from chapter_refs where work_id is not null), a as (select distinct work_id from works where lang = 'en'), m as (select * from l except select * from r), e as (select * from r except select * from l) select 'missing' as problem, work_id from (select * from m except select * from a) union all select 'extra', work_id from (select * from e except select * from a) union all select 'stale allowance', work_id from (select * from a except (select * from m union select * from e))",
    "range_expand": "select work_id, unnest(generate_series(1, n_books)) as book from works",
    "span_slices": "select distinct x.sent_id as sent_id, substring(ross_text, x.off_start + 1, x.off_end - x.off_start) as sentence from (select ross_text, unnest(ross_sents) as x from chapter_refs)",
    "line_gaps": 'select dialogue_id, cast(n as bigint) as "after", cast(nxt as bigint) as "next" from (select dialogue_id, turn_index as n, lead(turn_index) over (partition by dialogue_id order by turn_index) as nxt from (select distinct dialogue_id, turn_index from ref_turns)) where nxt > n + 1',
    "transposed": "select source, doc_id from (select source, doc_id, written_at, max(written_at) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding) as high from documents where written_at is not null and source is not null) where written_at < high",
    "chapter_ranges": "select work_id, cast(book as bigint) as book, start, cast(coalesce(lead(start) over (partition by work_id order by start) - 1, 999999999) as bigint) as range_end from (select work_id, book, min(chapter_id) as start from chapter_refs group by work_id, book)",
    "label_suppress": f"with h as (select *, last_value(speaker ignore nulls) over (partition by dialogue_id order by turn_index, ref_id rows between unbounded preceding and current row) as held from {_REF}) select ref_id, held, held is not null and not coalesce(held = lag(held) over (partition by dialogue_id order by turn_index, ref_id), false) as shown from h",
    "speaker_runs": f"with n as (select *, case when speaker is not distinct from lag(speaker) over w and row_number() over w > 1 then 0 else 1 end as new from {_REF} window w as (partition by dialogue_id order by turn_index, ref_id)), r as (select *, sum(case when row_number is null then 0 else new end) over (partition by dialogue_id order by turn_index, ref_id rows between unbounded preceding and current row) as run from (select *, 1 as row_number from n)) select dialogue_id, any_value(speaker) as speaker, cast(min(turn_index) as bigint) as \"first\", cast(max(turn_index) as bigint) as \"last\", count(*) as n from r group by dialogue_id, run",
    "coverage_depth": "select k, at_ as \"at\", cast(sum(d) over (partition by k order by at_) as bigint) as depth from (select k, at_, sum(d) as d from (select l_suppkey as k, l_orderkey as at_, 1 as d from lineitem union all select l_suppkey, l_orderkey + 41, -1 from lineitem) group by k, at_)",
    "sessionise": "select event_id, cast(sum(case when event_type = 'signup' then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as bigint) as section from events",
    "cumulative_words": r"select chapter_id, sent_id, cast(sum(n) over (partition by chapter_id order by seq, sent_id rows unbounded preceding) as bigint) as upto from (select distinct chapter_id, sent_id, seq, text, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \n]+'), lambda x: x <> '')) as n from gsents)",
    "ratio_robust_z": "with c as (select distinct chapter_id, ref_lang, ln(length(ref_text) / length(ross_text)) as x from chapter_refs where length(ross_text) > 0 and length(ref_text) > 0), m as (select ref_lang, median(x) as med, stddev_pop(x) as sd from c group by ref_lang), v as (select ref_lang, median(abs(x - med)) as mad from c join m using (ref_lang) group by ref_lang) select chapter_id, round((x - med) / coalesce(nullif(mad * 1.4826, 0), nullif(sd, 0), 1), 4) as z from c join m using (ref_lang) join v using (ref_lang)",
    "ratio_outliers": "select o_orderkey from (select o_orderkey, o_totalprice, avg(o_totalprice) over (partition by o_orderpriority) as m, stddev_pop(o_totalprice) over (partition by o_orderpriority) as sd from orders) where abs(o_totalprice - m) > 1.5 * sd",
    "error_summary": "select l_returnflag, count(*) as n, round(avg(l_quantity), 4) as mean, round(median(l_quantity), 4) as median, max(l_quantity) as most, round(avg(case when l_quantity = 1 then 1.0 else 0.0 end), 4) as exact_share from lineitem group by grouping sets ((l_returnflag), ())",
    "mode_first_seen": f"select dialogue_id, arg_max(speaker, (n, -o)) as speaker, arg_max(n, (n, -o)) as n from (select dialogue_id, speaker, count(*) as n, min(ref_id) as o from {_REF} where speaker is not null group by dialogue_id, speaker) group by dialogue_id",
    "name_window": r"with g as (select chapter_id, sent_id, names, row_number() over (partition by chapter_id order by seq, sent_id) as pos from (select distinct chapter_id, sent_id, seq, list_sort(list_distinct(regexp_extract_all(text, ' ([A-Z][a-z]+)', 1))) as names from gsents where lang = 'lat')), n as (select chapter_id, sent_id, pos, unnest(names) as name from g), w as (select *, pos - lag(pos) over v as a, lead(pos) over v - pos as b from n window v as (partition by chapter_id, name order by pos)) select sent_id, name from w where a = 1 or b = 1",
    "config_grid": "select l_linestatus, round(avg(l_discount) filter (where l_returnflag = 'A'), 4) as avg_a, round(avg(l_discount) filter (where l_returnflag = 'N'), 4) as avg_n, round(avg(l_discount) filter (where l_returnflag = 'R'), 4) as avg_r from lineitem group by l_linestatus",
    "merge_existing_wins": "with a as (select form, min(gloss) as g, true as h from analyses where lang in ('grc', 'lat') group by form), b as (select form, max(gloss) as g, true as h from analyses group by form) select coalesce(a.form, b.form) as form, case when a.h then a.g else b.g end as gloss, case when a.h is null then 'added' when b.h is null then 'kept' when a.g is not distinct from b.g then 'same' else 'conflict' end as status from a full join b on a.form = b.form",
    "tree_diff": f"select sent_id, state from {_DIFF}",
    "publish_decision": f"select count(*) filter (where state = 'identical') as identical, count(*) filter (where state = 'changed') as changed, count(*) filter (where state = 'removed') as removed, count(*) filter (where state = 'added') as added, case when count(*) filter (where state in ('changed', 'removed')) > 0 then 'refuse' when count(*) filter (where state = 'added') > 0 then 'upload' else 'noop' end as decision from {_DIFF}",
    "revision_fold": "select event_id, case when high is null or rev > high then 'write' when rev = high then 'idempotent' else 'reject' end as outcome from (select event_id, rev, max(rev) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as high from (select event_id, user_id, ts, cast(floor(value) as bigint) as rev from events) where rev is not null)",
    "facet_counts": "select lang, scheme, count(*) as n, count(distinct author) as authors from works group by grouping sets ((lang), (scheme), ())",
    "catalog_model": "select r_name, n_name, cast(coalesce(sum(customers), 0) as bigint) as customers from nation join region on n_regionkey = r_regionkey left join (select c_nationkey as k, count(*) as customers from customer group by 1) on n_nationkey = k group by rollup (r_name, n_name)",
    "recent_docs": "select work_id, doc_id, rank from (select work_id, doc_id, row_number() over (partition by work_id order by added_at desc nulls last, doc_id) as rank from documents where work_id is not null) where rank <= 3",
    "duplicates_casefold": "select lower(speaker) as k, count(*) as n, count(distinct dialogue_id) as dialogues from new_turns where speaker is not null group by 1 having count(*) > 1",
    "embedding_neighbours": "with e as (select vec_id, cast(embedding as double[]) as v from embeddings), s as (select a.vec_id as q, b.vec_id, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 4) as sim from e a, e b where a.vec_id % 50 = 0 and a.vec_id <> b.vec_id) select q, vec_id, sim from (select *, row_number() over (partition by q order by sim desc, vec_id) as r from s) where r <= 3",
}
QUERIES = {f.__name__: f for f in (asof_event, asof_citation, point_in_range, nearest_range, ranked_lookup, semi_needed, reconcile_works, range_expand, span_slices, line_gaps, transposed, chapter_ranges, label_suppress, speaker_runs, coverage_depth, sessionise, cumulative_words, ratio_robust_z, ratio_outliers, error_summary, mode_first_seen, name_window, config_grid, merge_existing_wins, tree_diff, publish_decision, revision_fold, port_text, facet_counts, catalog_model, recent_docs, duplicates_casefold, embedding_neighbours)}
