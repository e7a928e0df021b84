"""Scans of marked-up text, keys, and the plug-in surface."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import keys
from quire.operators import extend
from quire.sources import markup

XML = '<TEI xmlns="x"><div type="book" n="2"><head>Two</head><div type="chapter" n="1"><p n="a">One <hi>two</hi> three<note>n <b>m</b> o</note> four<pb n="7"/>five</p>outside<p>Last</p></div></div></TEI>'


def test_tei_with_mixed_content(spark):
    docs = spark.createDataFrame([("f", XML), ("bad", "<a><b></a>"), ("none", None), ("empty", "")], "file string, xml string")
    got = [tuple(r) for r in markup.tei(docs, ("book", "chapter")).collect()]
    rows = [(tuple(r[1]), r[3], r[4], r[5], r[6]) for r in got if r[0] == "f"]
    at = ("book:2", "chapter:1")
    assert rows == [(("book:2",), "head", "", 0, "Two"), (at, "text", "a", 0, "One two three fourfive"), (at, "note", "", 13, "n m o"), (at, "pb", "7", 18, None), (at, "text", "", 0, "Last")]
    assert [(r[0], r[3]) for r in got if r[0] != "f"] == [("bad", "error")]
    assert markup.tei(docs.limit(0), ()).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("tnlx"), st.text("ab &<", max_size=4)), max_size=8))
def test_prose_is_what_stands_outside_notes(parts):
    esc = lambda x: x.replace("&", "&amp;").replace("<", "&lt;")
    wrap = {"t": "{}", "n": "<note>{}</note>", "l": '<lb n="1"/>{}', "x": "<hi>{}</hi>"}
    xml = "<d><p>" + "".join(wrap[k].format(esc(s)) for k, s in parts) + "</p></d>"
    got = list(markup.events(xml, (), "p", ("note",), ("lb",)))
    assert next(r[5] for r in got if r[2] == "text") == "".join(s for k, s in parts if k != "n")
    assert [r[4] for r in got if r[2] == "lb"] == [sum(len(s) for k, s in parts[:i] if k != "n") for i, (k, _) in enumerate(parts) if k == "l"]


def test_keys_of_words(spark):
    df = spark.createDataFrame([("Ἡράκλειτος", True), ("ἄνθρωπός", False), ("προΐεντο", False), ("δ’", False), ("abc", False), (None, False)], "w string, c boolean")
    got = {r["w"]: r for r in df.select("w", keys.beta_key(F.col("w")).alias("k"), keys.greek_variants(keys.beta_key(F.col("w")), F.col("c")).alias("v")).collect()}
    assert got["Ἡράκλειτος"]["k"] == "h(ra/kleitos" and got["Ἡράκλειτος"]["v"][-1] == "*(hra/kleitos"
    assert got["ἄνθρωπός"]["k"] == "a)/nqrwpos" and got["δ’"]["k"] == "d'" and got["abc"]["k"] is None and got[None]["k"] is None
    assert got["προΐεντο"]["v"] == ["proi+/ento", "proi/ento", "proi(/ento", "proi)/ento"]
    with pytest.raises(Exception, match="no Beta Code"):
        df.where("w = 'abc'").select(keys.beta_key(F.col("w"), strict=True)).collect()
    latin = spark.createDataFrame([("Populusque",), ("atque",), ("ne",)], "w string").select(keys.latin_variants(F.lower("w"), F.col("w").rlike("^[A-Z]")).alias("v")).collect()
    assert [r["v"] for r in latin] == [["populusque", "populus", "Populusque", "Populus"], ["atque"], ["ne"]]
    told = spark.createDataFrame([("ιϛʹ",), ("λόγοςʹ",), ("ϛλόγος",), ("αʹ",), ("ab",)], "w string").select(keys.is_greek_numeral(F.col("w"))).collect()
    assert [r[0] for r in told] == [True, False, False, True, False]
    peeled = spark.createDataFrame([("«δ’»,",), ("λόγος.’",), ("‘λόγος’",)], "w string").select(keys.peel(F.col("w"))).collect()
    assert [r[0] for r in peeled][:2] == ["δ’", "λόγος"]


def test_registries(spark):
    assert np.allclose(extend.SIMILARITIES["lexical"](["a b"], ["a b"]), 1)
    with pytest.raises(KeyError, match="lexical"):
        extend.SIMILARITIES["none"]
    extend.SCHEMES.add("own", "^x$")
    with pytest.raises(ValueError, match="taken"):
        extend.SCHEMES.add("own", "^y$")
    assert extend.SCHEMES["own"] == "^x$" and "own" in extend.SCHEMES.names()
    key, fold, numeral = extend.LANGUAGES["lat"]
    row = spark.createDataFrame([("Ivlivs", "xiv")], "a string, b string").select(key(F.col("a")), fold(F.col("a")), numeral(F.col("b"))).first()
    assert tuple(row) == ("ivlivs", "iulius", True)
    extend.hook("book", lambda x: x + 1)
    assert extend.through_hooks("book", 1) == 2 and extend.through_hooks("none", 1) == 1
    extend.register_functions(spark, {"twice": lambda x: x * 2})
    assert spark.sql("select twice('ab') as x").first()["x"] == "abab"
    assert extend.Builder("turns") is extend.Builder.TURNS
