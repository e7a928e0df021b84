"""Scans of marked-up and framed text: XML editions, Markdown with notes, records of several lines."""

from __future__ import annotations

import io
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW = "file string, path array<string>, ord int, kind string, n string, offset int, text string"


def events(xml: str, levels: tuple[str, ...], unit: str, aside: tuple[str, ...], points: tuple[str, ...]) -> Iterator[tuple]:
    """(path, ord, kind, n, offset, text) of one document, in its order.

    ``levels`` are the types of divisions that make up the path; each ``unit`` element
    gives a row of its text, tails included. Elements ``aside`` (notes, heads, speakers)
    are rows of their own and no part of the text, ``points`` (milestones, breaks) mark a
    place in it. The parser streams: what is read is let go.
    """
    path: list[str] = []
    held: list[tuple[str, bool]] = []
    text, number, inside, out, at, ord_ = "", "", 0, None, 0, 0

    def add(s: str | None) -> None:
        nonlocal text
        if s and inside and out is None:
            text += s

    parser = ElementTree.iterparse(io.BytesIO(xml.encode("utf-8", "surrogatepass")), events=("start", "end"))
    waiting: list[tuple] = []
    last = None  # the element whose text or tail is still to be read
    for what, el in parser:
        tag = el.tag.rpartition("}")[2]
        if last is not None:
            kind, before = last
            add(before.text if kind == "start" else before.tail)
        last = (what, el)
        if what == "start":
            if tag == "div" and el.get("type") in levels:
                path.append(f"{el.get('type')}:{el.get('n', '')}")
                held.append((tag, True))
                continue
            held.append((tag, False))
            if out is not None:
                continue
            if tag == unit and not inside:
                inside, text, number, waiting = len(held), "", el.get("n", ""), []
            elif tag in points:
                waiting.append((tag, el.get("n", ""), len(text), None))
            elif tag in aside:
                out, at = len(held), len(text)
        else:
            _, level = held.pop()
            if level:
                path.pop()
            elif out == len(held) + 1:
                row = (tag, el.get("n", ""), at, "".join(el.itertext()))
                out = None
                if inside:
                    waiting.append(row)
                else:
                    yield list(path), ord_, *row
                    ord_ += 1
            elif inside == len(held) + 1:
                # The tail of what stood last within the unit is read by now.
                inside = 0
                yield list(path), ord_, "text", number, 0, text
                ord_ += 1
                for row in waiting:
                    yield list(path), ord_, *row
                    ord_ += 1
                waiting = []


def tei(docs: DataFrame, levels: tuple[str, ...], unit: str = "p", aside: tuple[str, ...] = ("note", "head", "speaker"), points: tuple[str, ...] = ("milestone", "pb", "lb")) -> DataFrame:
    """Rows of ``events`` over (file, xml). Null and empty documents give none; one that is not well formed is an error row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for f, x in zip(b["file"], b["xml"]):
                try:
                    rows += [(f, *e) for e in events(x, levels, unit, aside, points)]
                except ElementTree.ParseError as problem:
                    rows.append((f, [], -1, "error", None, None, str(problem)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ROW.split(", ")])

    return docs.where("xml <> ''").select("file", "xml").mapInPandas(run, ROW)


def markdown_notes(lines: DataFrame) -> DataFrame:
    """(file, kind, key, offset, text) of Markdown lines (file, line): notes defined, and the places that refer to them.

    A definition is a line that begins with its mark; a reference's offset is that in
    the line without marks.
    """
    mark = r"\[\^([^\]\s]+)\]"
    notes = lines.where(F.col("line").rlike(rf"^{mark}:")).select("file", F.lit("note").alias("kind"), F.regexp_extract("line", mark, 1).alias("key"), F.lit(0).alias("offset"), F.trim(F.regexp_replace("line", rf"^{mark}:", "")).alias("text"))
    body = lines.where(~F.col("line").rlike(rf"^{mark}:") & F.col("line").rlike(mark))
    parts, keys = F.split("line", mark), F.regexp_extract_all("line", F.lit(mark), F.lit(1))
    refs = body.select("file", parts.alias("p"), F.posexplode(keys).alias("i", "key"))
    at = F.length(F.array_join(F.slice("p", F.lit(1), F.col("i") + 1), ""))
    return notes.unionByName(refs.select("file", F.lit("ref").alias("kind"), "key", at.alias("offset"), F.array_join("p", "").alias("text")))


def framed(spark, path: str, wanted: DataFrame | None = None, separator: str = "\n\n") -> DataFrame:
    """(key, field, value) of records of several lines ``field=value``, the first line ``@key``; records of ``wanted`` keys alone."""
    r = spark.read.option("lineSep", separator).text(path).select(F.regexp_extract("value", r"^@(\S+)", 1).alias("key"), F.split("value", "\n").alias("l")).where("key <> ''")
    if wanted is not None:
        r = r.join(wanted.select("key").distinct(), "key", "left_semi")
    f = r.select("key", F.explode(F.slice("l", 2, 1_000_000)).alias("x")).where("contains(x, '=')")
    return f.select("key", F.substring_index("x", "=", 1).alias("field"), F.expr("substring(x, instr(x, '=') + 1)").alias("value"))
