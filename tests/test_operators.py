from __future__ import annotations

import json
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import text
from quire.operators import align, cite, index, joins, markup, merge, quality, sequence
from quire.sources import tables
from quire.streaming import terms


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_strip_accents_equals_decomposition(spark):
    points = [chr(c) for c in range(0xA0, 0x2000) if unicodedata.normalize("NFD", chr(c)) != chr(c)]
    points = [p for p in points if not unicodedata.combining((d := unicodedata.normalize("NFD", p))[0]) and all(map(unicodedata.combining, d[1:]))]
    got = spark.createDataFrame([(p,) for p in points], "c string").select("c", text.strip_accents(F.col("c")).alias("s")).collect()
    assert all(r["s"] == "".join(x for x in unicodedata.normalize("NFD", r["c"]) if not unicodedata.combining(x)) for r in got)


def test_numbers(spark):
    df = spark.createDataFrame([("xiv", "ιδ"), ("MCMXC", "ρκγ"), ("abc", "η"), (None, None)], "r string, g string")
    assert [tuple(r) for r in df.select(text.roman(F.col("r")), text.greek_number(F.col("g"))).collect()] == [(14, 14), (1990, 123), (None, 8), (None, None)]


def test_phrase_with_repeats_and_edges(spark):
    docs = spark.createDataFrame([(1, "the the the end"), (2, "end of the end"), (3, ""), (4, None)], "id long, t string")
    i = index.postings(docs, "id", "t")
    assert rows(index.search_phrase(i, ["the", "the"])) == [(1, 0), (1, 1)]
    assert rows(index.search_phrase(i, ["the", "end"])) == [(1, 2), (2, 2)]
    assert rows(index.search_all(i, ["en*", "of"])) == [(2,)]


def test_asof_ties_and_nulls(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9), (4, None, 3)], "id long, k string, t int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("b", 10, "z"), (None, 1, "n")], "k string, t int, v string")
    assert {r["id"]: r["asof_v"] for r in joins.asof(left, right, ["k"], "t", "v").collect()} == {1: "y", 2: None, 3: None, 4: "n"}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(-50, 50), max_size=8), st.lists(st.tuples(st.integers(-50, 50), st.integers(0, 20)), max_size=6))
def test_interval_join_equals_brute_force(spark, points, spans):
    p = spark.createDataFrame([(i, x) for i, x in enumerate(points)], "p long, x int")
    s = spark.createDataFrame([(i, a, a + n) for i, (a, n) in enumerate(spans)], "s long, lo int, hi int")
    want = sorted((i, j) for i, x in enumerate(points) for j, (a, n) in enumerate(spans) if a <= x <= a + n)
    assert rows(joins.contains(p, "x", s, "lo", "hi", 7).select("p", "s")) == want


def test_ranked_lookup_and_reconcile(spark):
    keys = spark.createDataFrame([("Ab",), ("cd",), ("zz",)], "k string")
    table = spark.createDataFrame([("ab", "2"), ("ab", "1"), ("cd", "3")], "f string, v string")
    assert rows(joins.ranked_lookup(keys, "k", [F.col("k"), F.lower("k")], table, "f", "v")) == [("Ab", "1", 1), ("cd", "3", 0)]
    a, b, ok = (spark.createDataFrame([(x,) for x in s], "k string") for s in ("xy", "yz", "zq"))
    assert rows(joins.reconcile(a, b, "k", ok)) == [("missing", "x"), ("stale allowance", "q")]


def test_sequence(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("a", 5, "x"), ("a", 6, "y")], "g string, n int, l string")
    assert rows(sequence.gaps(df, ["g"], "n")) == [("a", 2, 5)]
    assert [r["shown"] for r in sequence.carry(df, ["g"], ["n"], "l").orderBy("n").collect()] == [True, False, False, True]
    assert rows(sequence.coverage(spark.createDataFrame([(1, 1, 3), (1, 2, 4)], "k int, a int, b int"), ["k"], "a", "b")) == [(1, 1, 1), (1, 2, 2), (1, 4, 1), (1, 5, 0)]
    lines = spark.createDataFrame([(1, 0, "the mar-"), (1, 1, "ket was full"), (1, 2, "of peo-")], "d int, o int, t string")
    assert [r["healed"] for r in sequence.rejoin_hyphens(lines, ["d"], "o", "t").orderBy("o").collect()] == ["the market", "was full", "of peo-"]


def test_merges(spark):
    old = spark.createDataFrame([("a", "1"), ("b", None)], "k string, v string")
    new = spark.createDataFrame([("a", "2"), ("b", "3"), ("c", "4")], "k string, v string")
    assert rows(merge.merge(old, new, "k", "v", "old")) == [("a", "1", "conflict"), ("b", None, "conflict"), ("c", "4", "added")]
    assert rows(merge.merge(old, new, "k", "v", "new")) == [("a", "2", "conflict"), ("b", "3", "conflict"), ("c", "4", "added")]
    assert merge.decision(merge.diff(old.where("v is not null"), new, "k", "v")).first()["decision"] == "refuse"
    chain = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 5), (5, 4)], "k long, p long")
    assert rows(merge.resolve_chain(chain, "k", "p", 4)) == [(1, 1, 0), (2, 1, 1), (3, 1, 2), (4, None, None), (5, None, None)]


def test_alignment_functions():
    assert align.lcs(list("abcd"), list("acbd")) == [(0, 0), (2, 1), (3, 3)]
    s = align.similarity(["red fox", "blue sea"], ["red fox runs", "old oak", "blue sea"])
    assert align.monotone(s) == [0, 2]
    assert align.beads(["one two three four five six"], ["one two three", "four five six"]) == [(0, 1, 0, 2)]


def test_align_groups_with_gaps(spark):
    a = spark.createDataFrame([(1, 0, "x", "hello there"), (1, 1, None, None), (2, 0, "x", "alone")], "g long, ord long, label string, text string")
    b = spark.createDataFrame([(1, 0, "x", "hello there")], "g long, ord long, label string, text string")
    assert rows(align.align_groups(a, b, "g", "global")) == [(1, 0, 0)]


def test_cite_and_markup(spark):
    c = spark.createDataFrame([("219d",), ("4.274",), ("B12",), ("65",), ("??",), (None,)], "c string")
    assert [r[0] for r in c.select(cite.scheme(F.col("c"))).collect()] == ["page_column", "book_number", "fragment", "number", None, None]
    order = c.where("c like '%d' or c rlike '^[0-9]'").orderBy(cite.sort_key(F.col("c")))
    assert order.count() == 3
    h = spark.createDataFrame([("<p onclick='x'>A<script>b()</script> &amp; <foo>c</foo><!-- d --></p>",)], "h string")
    assert h.select(markup.sanitize(F.col("h"))).first()[0] == "<p>A &amp; c</p>"
    assert h.select(markup.plain(markup.sanitize(F.col("h")))).first()[0] == "A & c"


def test_strict_checks_raise(spark):
    found = quality.duplicates(spark.createDataFrame([(1,), (1,)], "k long"), ["k"], "twice")
    assert found.count() == 1
    with pytest.raises(Exception, match="twice"):
        quality.strict(found).collect()


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"b": 1, "c": "x", "t": "one"}, {"b": 2, "c": "y", "t": "two"}]))
    assert rows(tables.json_records(spark, str(tmp_path / "a.json"), ["b", "c"], "t")) == [("1.x", "one"), ("2.y", "two")]
    (tmp_path / "m.tsv").write_text("ab\t{1 9 ab,ab1\tgloss one\tnoun}{2 9 ab,ab2\tgloss two\tverb}\nzz\t{3 9 z,z\tq\tr}\n")
    got = tables.analyses_lines(spark, str(tmp_path / "m.tsv"), spark.createDataFrame([("ab",)], "form string"))
    assert rows(got) == [("ab", 0, "ab1", "gloss one", "noun"), ("ab", 1, "ab2", "gloss two", "verb")]
    (tmp_path / "t.txt").write_text("intro\nCHAPTER I\nx\nCHAPTER II\ny")
    assert [r["section"] for r in tables.marked_text(spark, str(tmp_path / "t.txt"), "^CHAPTER").orderBy("line_no").collect()] == [0, 1, 1, 2, 2]
    assert tables.optional(spark, str(tmp_path / "none.parquet"), T.StructType([T.StructField("a", T.LongType())])).count() == 0
    assert tables.release_index(spark, str(tmp_path), "json$").count() == 2


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a"), (2, None), (3, "b")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    q = terms.term_counts(terms.documents(spark, str(tmp_path / "in"), docs.schema)).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    assert rows(spark.table("counts")) == [("a", 2), ("b", 2)]


def test_hunks_and_beta(spark):
    df = spark.createDataFrame([(1, "the kiug saw", "the king saw"), (2, "a b c", "a c d"), (3, None, "x"), (4, "", "")], "k long, a string, b string")
    assert rows(align.hunks(df, "k", "a", "b")) == [(1, 1, "kiug", "king"), (2, 1, "b", ""), (2, 3, "", "d")]
    g = spark.createDataFrame([("ναύτης",), ("Σωσίας",)], "c string").select(text.greek_from_beta(text.beta(F.col("c"))))
    assert [r[0] for r in g.collect()] == ["ναυτης", "σωσιας"]
