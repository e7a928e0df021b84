"""Scans and sinks over files written from the tables, in the shared folder."""

from __future__ import annotations

import hashlib
import os
import tempfile

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import index
from quire.plans.text import POSTINGS
from quire.sources import markup, tables
from quire.sources.tables import read


def _path(s, d, name: str) -> str:
    """A place of one's own in the folder that the cluster shares; without one, on the one machine there is."""
    base = s.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not s.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        base = "file://" + os.path.join(tempfile.gettempdir(), "quire-files")
    return f"{base}/quire-{name}-{hashlib.sha256(f'{d} {s.sparkContext.applicationId}'.encode()).hexdigest()[:12]}"


def _written(s, d, name: str, docs):
    """XML documents written one to a line, and read again."""
    path = _path(s, d, name)
    docs.select(F.concat_ws("\t", "file", F.replace("xml", F.lit("\n"), F.lit("&#10;")))).write.mode("overwrite").text(path)
    return s.read.text(path).select(F.substring_index("value", "\t", 1).alias("file"), F.expr("substring(value, instr(value, '\\t') + 1)").alias("xml"))


def _escape(c):
    return F.replace(F.replace(F.replace(F.replace(F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;")), F.lit("\r"), F.lit("&#13;"))


def _chapters(s, d):
    c = read(s, d, "chapter_refs").where("chapter_id is not null and ross_text <> '' and book is not null and chapter is not null").select("chapter_id", "book", "chapter", "citation", "ross_text").distinct()
    xml = F.concat(F.lit('<text><div type="book" n="'), F.col("book").cast("string"), F.lit('"><div type="chapter" n="'), _escape(F.col("chapter")), F.lit('"><head>'), _escape(F.coalesce("citation", F.lit(""))), F.lit("</head><p>"), _escape(F.col("ross_text")), F.lit("<note>by hand</note></p></div></div></text>"))
    return _written(s, d, "chapters", c.select(F.col("chapter_id").cast("string").alias("file"), xml.alias("xml")))


def tei_chapters(s, d):
    """Prose by book and chapter, without heads and notes."""
    t = markup.tei(_chapters(s, d), ("book", "chapter")).where("kind = 'text'")
    part = [F.substring_index(F.col("path")[k], ":", -1) for k in range(2)]
    return t.select(F.col("file").cast("long").alias("chapter_id"), part[0].cast("long").alias("book"), part[1].alias("chapter"), T.collapse(F.col("text")).alias("text"))


def tei_asides(s, d):
    """What stands beside the prose: heads before it, notes with their place in it."""
    t = markup.tei(_chapters(s, d), ("book", "chapter")).where("kind in ('head', 'note')")
    return t.select(F.col("file").cast("long").alias("chapter_id"), "kind", F.col("offset").cast("long").alias("offset"), "text")


def tei_lines(s, d):
    """Printed lines of flat pages: page, number and text."""
    g = read(s, d, "gsents").where("sent_id is not null and size(lines) > 0").select("sent_id", F.col("lines")[0].alias("l"), "text").distinct().where(r"l rlike '^(.+)\\.(\\d+)$'")
    xml = F.concat(F.lit('<text><div type="page" n="'), F.regexp_extract("l", r"^(.+)\.(\d+)$", 1), F.lit('"><l n="'), F.regexp_extract("l", r"^(.+)\.(\d+)$", 2), F.lit('">'), _escape(F.col("text")), F.lit("</l></div></text>"))
    t = markup.tei(_written(s, d, "lines", g.select(F.col("sent_id").cast("string").alias("file"), xml.alias("xml"))), ("page",), "l").where("kind = 'text'")
    return t.select(F.col("file").cast("long").alias("sent_id"), F.substring_index(F.col("path")[0], ":", -1).alias("page"), F.col("n").cast("long").alias("line"), T.collapse(F.col("text")).alias("text"))


def tei_speakers(s, d):
    """Speeches of dialogues with the speaker set apart from what they say."""
    r = read(s, d, "ref_turns").where("ref_id is not null and speaker is not null and text is not null").select("ref_id", "dialogue_id", "speaker", "text").distinct()
    xml = F.concat(F.lit('<text><div type="page" n="'), F.coalesce(F.col("dialogue_id").cast("string"), F.lit("")), F.lit('"><sp><p><speaker>'), _escape(F.col("speaker")), F.lit("</speaker>"), _escape(F.col("text")), F.lit("</p></sp></div></text>"))
    t = markup.tei(_written(s, d, "speakers", r.select(F.col("ref_id").cast("string").alias("file"), xml.alias("xml"))), ("page",))
    return t.groupBy(F.col("file").cast("long").alias("ref_id")).agg(F.max(F.when(F.col("kind") == "speaker", F.col("text"))).alias("speaker"), F.max(F.when(F.col("kind") == "text", F.length("text"))).cast("long").alias("size"))


def tei_milestones(s, d):
    """Places marked within prose, as offsets into its text."""
    c = read(s, d, "chapter_refs").where("chapter_id is not null and ref_text <> ''").select("chapter_id", "ref_text", "ref_anchors").distinct()
    a = c.select("chapter_id", "ref_text", F.explode("ref_anchors").alias("a")).where("a.off between 0 and length(ref_text)")
    xml = F.concat(F.lit("<text><p>"), _escape(F.substring("ref_text", F.lit(1), F.col("a.off"))), F.lit('<milestone n="'), F.col("a.citation"), F.lit('"/>'), _escape(F.substring("ref_text", F.col("a.off") + 1, F.length("ref_text"))), F.lit("</p></text>"))
    t = markup.tei(_written(s, d, "milestones", a.select(F.col("chapter_id").cast("string").alias("file"), xml.alias("xml"))), ()).where("kind = 'milestone'")
    return t.select(F.col("file").cast("long").alias("chapter_id"), F.col("n").alias("citation"), F.col("offset").cast("long").alias("off")).distinct()


def markdown_scan(s, d):
    """Notes of Markdown text, and the places that refer to them."""
    f = read(s, d, "footnote_defs").where("def_id is not null and text <> ''").select("def_id", T.collapse(F.col("text")).alias("t")).distinct().where("t not rlike '[\\\\[\\\\]^]'")
    path = _path(s, d, "markdown")
    lines = F.explode(F.array(F.concat(F.lit("Text"), F.lit("[^"), F.col("def_id"), F.lit("] goes on")), F.concat(F.lit("[^"), F.col("def_id"), F.lit("]: "), F.col("t"))))
    f.select(lines.alias("value")).write.mode("overwrite").text(path)
    t = markup.markdown_notes(s.read.text(path).select(F.lit("f").alias("file"), F.col("value").alias("line")))
    return t.select("kind", F.col("key").cast("long").alias("def_id"), F.col("offset").cast("long").alias("offset"), "text")


def record_scan(s, d):
    """Records of several lines, those of wanted keys alone."""
    c = read(s, d, "corrections").where("corr_id is not null and find is not null and replace is not null").select("corr_id", "find", "replace").distinct()
    path = _path(s, d, "records")
    flat = lambda x: F.regexp_replace(x, r"[\r\n]", " ")
    c.select(F.concat(F.lit("@"), F.col("corr_id").cast("string"), F.lit("\nfind="), flat(F.col("find")), F.lit("\nreplace="), flat(F.col("replace"))).alias("value")).write.mode("overwrite").option("lineSep", "\n\n").text(path)
    wanted = read(s, d, "corrections").where("citation is not null").select(F.col("corr_id").cast("string").alias("key"))
    return markup.framed(s, path, wanted).select(F.col("key").cast("long").alias("corr_id"), "field", "value")


def lexicon_scan(s, d):
    """A tab-separated lexicon written with its groups, and read for the forms that the Latin originals need."""
    a = read(s, d, "analyses").where("lang = 'lat' and form not rlike '[{}\\t,]' and gloss not rlike '[{}\\t]'").select("form", "lemma", "gloss", "parse").distinct()
    group = F.concat(F.lit("{1 9 "), "form", F.lit(","), "lemma", F.lit("\t"), "gloss", F.lit("\t"), F.coalesce("parse", F.lit("")), F.lit("}"))
    path = _path(s, d, "lexicon")
    a.groupBy("form").agg(F.array_join(F.array_sort(F.collect_list(group)), "").alias("g")).select(F.concat_ws("\t", "form", "g")).write.mode("overwrite").text(path)
    need = read(s, d, "gsents").where("lang = 'lat'").select(F.explode(F.split("text", r"[^A-Za-z]+")).alias("form"))
    return tables.analyses_lines(s, path, need).select("form", "lemma", "gloss", "parse")


def json_scan(s, d):
    """Records written as JSON by the sink, and read by their keys with a prefix."""
    path = _path(s, d, "json")
    tables.write_json(read(s, d, "fragments").where("column_key is not null and work_id is not null and text <> ''").groupBy("work_id", "column_key").agg(F.min("text").alias("text")), path, "work_id")
    return tables.json_records(s, path, ["work_id", "column_key"], "text", "oto", lines=True)


def csv_scan(s, d):
    """Rows written as CSV with quotes and two-byte line ends, and read again."""
    path = _path(s, d, "csv")
    tables.write_csv(read(s, d, "works").select("work_id", F.concat(F.lit('"'), "title", F.lit('", and more')).alias("title")), path)
    t = s.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return t.toDF("work_id", "title")


def sharded_scan(s, d):
    """The sharded sink: rows by shard, in order of their key within each."""
    path = _path(s, d, "shards")
    tables.write_sharded(read(s, d, "analyses").select("form", "lemma").distinct(), path, F.coalesce(F.nullif(F.regexp_extract(T.strip_accents(F.lower("form")), "[a-z]", 0), F.lit("")), F.lit("_")), "form")
    return s.read.parquet(path).groupBy(F.col("shard").cast("string").alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.min("form").alias("first"))


def stored_search(s, d):
    """A search over the written index, which is clustered by term: the scan takes the term as a pushed filter."""
    path = _path(s, d, "index")
    index.write_index(index.postings(read(s, d, "documents"), "doc_id", "text"), path)
    stored = index.read_index(s, path)
    return index.search_phrase(stored, ["in", "the", "garden"]).select("seg", F.col("pos").cast("long").alias("pos"))


def value_states(s, d):
    """Stored values by state: there, absent, or not of the agreed form."""
    v = F.from_json(F.concat(F.lit('{"v":'), "locus", F.lit("}")), "v bigint, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    state = F.when(F.col("locus").isNull(), "absent").when(v["v"].isNotNull(), "ok").otherwise("malformed")
    return read(s, d, "documents").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def mounted(s, d):
    """Another corpus' rows beside our own, in one shape; what it lacks is null."""
    own = read(s, d, "fragments").where("frag_id is not null").select(F.lit("own").alias("corpus"), F.col("frag_id").alias("id"), "work_id", "kind").distinct()
    other = read(s, d, "corrections").where("corr_id is not null").select(F.lit("other").alias("corpus"), F.col("corr_id").alias("id"), "work_id").distinct()
    t = own.unionByName(other, allowMissingColumns=True)
    return t.groupBy("corpus").agg(F.count(F.lit(1)).alias("n"), F.count("kind").alias("kinds"), F.countDistinct("work_id").alias("works"))


def legacy_postings(s, d):
    """Postings of places brought to the older form: each word's segments, once and in order."""
    p = index.postings(read(s, d, "footnote_defs").select("def_id", "text").distinct(), "def_id", "text").select("term", "seg").distinct()
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.min("seg").alias("first"), F.max("seg").alias("last"))


_CH = "(select distinct chapter_id, book, chapter, citation, ross_text from chapter_refs where chapter_id is not null and ross_text <> '' and book is not null and chapter is not null)"
_CL = "trim(regexp_replace({x}, '\\s+', ' ', 'g'), ' ')"
SQL = {
    "tei_chapters": f"select chapter_id, book, chapter, {_CL.format(x='ross_text')} as text from {_CH}",
    "tei_asides": f"select chapter_id, 'head' as kind, 0 as \"offset\", coalesce(citation, '') as text from {_CH} union all select chapter_id, 'note', length(ross_text), 'by hand' from {_CH}",
    "tei_lines": f"select sent_id, regexp_extract(l, '^(.+)\\.(\\d+)$', 1) as page, cast(regexp_extract(l, '^(.+)\\.(\\d+)$', 2) as bigint) as line, {_CL.format(x='text')} as text from (select distinct sent_id, lines[1] as l, text from gsents where sent_id is not null and len(lines) > 0) where regexp_matches(l, '^(.+)\\.(\\d+)$') and text is not null",
    "tei_speakers": "select distinct ref_id, speaker, length(text) as size from ref_turns where ref_id is not null and speaker is not null and text is not null",
    "tei_milestones": "select distinct chapter_id, a.citation as citation, a.off as off from (select chapter_id, ref_text, unnest(ref_anchors) as a from chapter_refs where chapter_id is not null and ref_text <> '') where a.off between 0 and length(ref_text)",
    "markdown_scan": f"with f as (select distinct def_id, {_CL.format(x='text')} as t from footnote_defs where def_id is not null and text <> '') select 'note' as kind, def_id, 0 as \"offset\", t as text from f where not regexp_matches(t, '[\\[\\]^]') union all select 'ref', def_id, 4, 'Text goes on' from f where not regexp_matches(t, '[\\[\\]^]')",
    "record_scan": "with c as (select distinct corr_id, find, replace from corrections where corr_id is not null and find is not null and replace is not null) select corr_id, 'find' as field, regexp_replace(find, '[\\r\\n]', ' ', 'g') as value from c where corr_id in (select corr_id from corrections where citation is not null) union all select corr_id, 'replace', regexp_replace(replace, '[\\r\\n]', ' ', 'g') from c where corr_id in (select corr_id from corrections where citation is not null)",
    "lexicon_scan": "select distinct form, lemma, gloss, coalesce(parse, '') as parse from analyses where lang = 'lat' and not regexp_matches(form, '[{}\\t,]') and not regexp_matches(gloss, '[{}\\t]') and form in (select unnest(regexp_split_to_array(text, '[^A-Za-z]+')) from gsents where lang = 'lat')",
    "json_scan": "select work_id || '.' || column_key as key, min(text) as value from fragments where column_key is not null and starts_with(work_id, 'oto') and text <> '' group by work_id, column_key",
    "csv_scan": "select work_id, '\"' || title || '\", and more' as title from works",
    "sharded_scan": "select coalesce(nullif(regexp_extract(strip_accents(lower(form)), '[a-z]'), ''), '_') as shard, count(*) as n, min(form) as first from (select distinct form, lemma from analyses) group by 1",
    "stored_search": f"select a.seg, a.pos from {POSTINGS} a join {POSTINGS} b on a.seg = b.seg and b.pos = a.pos + 1 join {POSTINGS} c on a.seg = c.seg and c.pos = a.pos + 2 where a.term = 'in' and b.term = 'the' and c.term = 'garden'",
    "value_states": "select case when locus is null then 'absent' when regexp_matches(locus, '^-?(0|[1-9][0-9]*)$') then 'ok' else 'malformed' end as state, count(*) as n from documents group by 1",
    "mounted": "select 'own' as corpus, count(*) as n, count(kind) as kinds, count(distinct work_id) as works from (select distinct frag_id, work_id, kind from fragments where frag_id is not null) union all select 'other', count(*), 0, count(distinct work_id) from (select distinct corr_id, work_id from corrections where corr_id is not null)",
    "legacy_postings": "select term, count(*) as n, min(def_id) as first, max(def_id) as last from (select distinct unnest(regexp_extract_all(lower(text), '([a-z'']+)', 1)) as term, def_id from footnote_defs) group by term",
}
QUERIES = {f.__name__: f for f in (tei_chapters, tei_asides, tei_lines, tei_speakers, tei_milestones, markdown_scan, record_scan, lexicon_scan, json_scan, csv_scan, sharded_scan, stored_search, value_states, mounted, legacy_postings)}
