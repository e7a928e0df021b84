"""Sentence alignment in bitext space.

Two texts of a chapter span a rectangle whose axes are their characters. Points of
correspondence are words that translate each other (a lexicon learned over all chapters
by log-likelihood ratio, with the glosses that there are), equal numbers, and names
equal after transliteration. From the origin a rectangle of the bitext's slope grows
until it holds a chain of points with small dispersal about the slope; the chain's end is
the next origin. Points in crowded rows and columns count as noise within a rectangle.
What lies beside the chains is searched for chains of its own (inversions), in
rectangles of a clause by a clause. Chains become blocks: within their rectangles, and
nowhere else, cells of clauses compete for the points that support them, and the
sentences of the cells that win are pairs.
"""

from __future__ import annotations

import bisect
import heapq
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, cut, latest, pieces, record
from .lookalike import LOOKALIKES

CHAIN = 5
DISPERSAL = 0.35
#: Up to these rows the lexicon is sent to every task; beyond, each chapter gets the rows it needs by a join.
MOST_WORDS, MOST_LINKS = 500_000, 500_000
#: Word pairs that a task holds before it folds them into counts, and counts before it passes them on.
PENDING, HELD = 1 << 20, 1 << 19
LINK_LLR = 15.0
FREQUENT = 0.22
#: Occurrences from which a type's capitals are counted, and the share of capitalised types from which they mark no names.
TYPES, CAPITALS = 20, 0.2

_FOLD = str.maketrans({k: v for k, v in LOOKALIKES.items() if k.islower()})
# Latin letters for Greek ones, given after look-alike folding.
_GREEK = {
    "a": "a", "β": "b", "y": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th", "i": "i", "k": "k", "λ": "l", "μ": "m", "v": "n",
    "ξ": "x", "o": "o", "π": "p", "p": "r", "σ": "s", "ς": "s", "τ": "t", "u": "y", "φ": "ph", "x": "ch", "ψ": "ps", "ω": "o",
}
#: Signs between the clauses of a sentence: each statement lies within one.
_BREAK = re.compile(r"[,;:··;()\[\]“”„«»\"…!?]|\.\s*[.“”„«»\"]|\.\s+")
_WORD = re.compile(r"[^\W\d_]+|\d+(?:[.,]\d+)*")


@lru_cache(1 << 16)
def fold(word: str) -> str:
    w = unicodedata.normalize("NFKD", word.lower())
    w = "".join(ch for ch in w if not unicodedata.combining(ch)).translate(_FOLD)
    return w.replace("ς", "σ")


def latin(folded: str) -> str:
    return "".join(_GREEK.get(ch, ch) for ch in folded.replace("ou", "\0")).replace("\0", "u")


@dataclass
class Side:
    """Words of one text in order: keys, whether each may be a name, its place, sentence and clause."""

    lang: str
    ids: list[int]
    keys: list[str]
    name: list[bool]
    at: list[int]
    sent: list[int]
    clause: list[int]
    length: int

    def row(self) -> tuple:
        nums = np.array([self.at, self.sent, self.clause, self.name], dtype=np.int32)
        return self.lang, self.ids, "\n".join(self.keys), nums.tobytes(), self.length

    @staticmethod
    def of(lang: str | None, ids, keys: str, nums: bytes, length: int) -> Side:
        at, sent, clause, name = np.frombuffer(nums, dtype=np.int32).reshape(4, -1).tolist()
        return Side(lang, [] if ids is None else list(ids), keys.split("\n") if keys else [], name, at, sent, clause, int(length))


def read(lang: str, ids: list[int], sents: list[str]) -> Side:
    """``name`` is set where a capital stands within a sentence, or may be one at its start."""
    out, at, clause = Side(lang, ids, [], [], [], [], [], 0), 0, 0
    for k, s in enumerate(sents):
        s = s or ""
        if not s.isascii():
            s = "".join(ch for ch in unicodedata.normalize("NFC", s) if ch.isascii() or unicodedata.category(ch) != "Cf")
        clause, last = clause + 1, 0
        for m in _WORD.finditer(s):
            w = m[0]
            clause += bool(_BREAK.search(s, last, m.start()))
            last = m.end()
            out.keys.append("#" + w if w[0].isdigit() else fold(w))
            out.name.append(w[0].isupper() and len(w) > 2)
            out.at.append(at + m.start())
            out.sent.append(k)
            out.clause.append(clause)
        at += len(s) + 1
    out.length = at
    return out


class Lexicon:
    """Words by language, numbered, with their sentences (``df``) and whether they are names; links as arrays by the first word's number."""

    def __init__(self, sents: dict[str, int], words: Iterable[tuple[str, str, int, bool]], links: Iterable[tuple[str, str, str, str, float]] = ()):
        self.sents = sents
        self.ids: dict[str, dict[str, int]] = defaultdict(dict)
        df, name = defaultdict(list), defaultdict(list)
        for la, w, n, is_name in words:
            self._number(la, w, n, is_name, df, name)
        by: dict[tuple[str, str], dict[tuple[int, int], float]] = defaultdict(dict)
        for la, lb, w, v, x in links:
            at = self._number(la, w, 0, False, df, name), self._number(lb, v, 0, False, df, name)
            by[la, lb][at] = max(x, by[la, lb].get(at, 0.0))
        self.df = {la: np.array(x, dtype=np.int64) for la, x in df.items()}
        self.name = {la: np.array(x, dtype=bool) for la, x in name.items()}
        self.links: dict[tuple[str, str], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for two in list(by):
            got = by.pop(two)
            at = np.array(list(got), dtype=np.int64)
            order = np.argsort(at[:, 0], kind="stable")
            starts = np.searchsorted(at[order, 0], np.arange(len(self.ids[two[0]]) + 1)).astype(np.int32)
            self.links[two] = starts, at[order, 1].astype(np.int32), np.fromiter(got.values(), float, len(got))[order]
        self.told: dict = {}

    def _number(self, la: str, w: str, n: int, is_name: bool, df: dict, name: dict) -> int:
        k = self.ids[la].setdefault(w, len(self.ids[la]))
        if k == len(df[la]):
            df[la].append(n)
            name[la].append(is_name)
        return k

    def __getstate__(self) -> dict:
        return self.__dict__ | {"told": {}}

    def _once(self, what: str, lang, made):
        """What is worked out from the arrays, once in each process."""
        if (what, lang) not in self.told:
            self.told[what, lang] = made()
        return self.told[what, lang]

    def linkable(self, lang: str) -> bytes:
        """By number: of words that get links."""
        return self._once("linkable", lang, lambda: ((self.df[lang] > 2) & ~self.name[lang]).tobytes() if lang in self.df else b"")

    def weights(self, lang: str) -> np.ndarray:
        """By number: 0 of words too frequent to tell anything; at the end that of words unknown."""

        def made() -> np.ndarray:
            n, most = self.sents.get(lang, 0) + 1, FREQUENT * self.sents.get(lang, 1)
            df = self.df[lang].tolist() if lang in self.df else []
            return np.array([0.0 if k > most else max(1e-6, math.log(n / (k + 0.5))) for k in [*df, 0]])

        return self._once("weights", lang, made)

    def linked(self, la: str, lb: str, key: str) -> list[tuple[str, float]]:
        """Words of ``lb`` with their strength."""
        if (la, lb) not in self.links:
            return []
        known = self._once("linked", (la, lb), dict)
        if (got := known.get(key)) is None:
            if len(known) > 20_000:
                known.clear()
            got, k = [], self.ids[la].get(key)
            if k is not None:
                words = self._once("words", lb, lambda: list(self.ids[lb]))
                starts, v, x = self.links[la, lb]
                got = [(words[i], y) for i, y in zip(v[starts[k] : starts[k + 1]].tolist(), x[starts[k] : starts[k + 1]].tolist())]
            known[key] = got
        return got


def weights(side: Side, lex: Lexicon) -> list[float]:
    """The weight of each word of a side; 0 for words too frequent to tell anything."""
    ids = lex.ids.get(side.lang, {})
    return lex.weights(side.lang)[np.array([ids.get(key, -1) for key in side.keys], dtype=np.int64)].tolist()


def _near(n: int, m: int) -> Iterator[tuple[int, int]]:
    """Sentence pairs about the diagonal of an n by m grid."""
    for i in range(n):
        mid = (i + 0.5) / n * m - 0.5
        for j in range(max(0, math.floor(mid - 1)), min(m, math.ceil(mid + 1) + 1)):
            yield i, j


def chapters(chapter_refs: DataFrame, gsents: DataFrame) -> DataFrame:
    """One row for each translated chapter: languages, ids and texts of the sentences of its three sides.

    Null texts and offsets leave a side empty. Sentences of a chapter without
    translation do not take part and are never grouped.
    """
    c = latest(chapter_refs, "chapter_id", "loaded_at", ["ross_lang", "ross_text", "ross_sents", "ref_lang", "ref_text", "ref_sents"])

    def side(text: str, sents: str):
        use = F.coalesce(F.filter(sents, lambda x: x["sent_id"].isNotNull() & x["off_start"].isNotNull() & x["off_end"].isNotNull()), F.array().cast("array<struct<sent_id:bigint,off_start:int,off_end:int>>"))
        return [F.transform(use, lambda x: x["sent_id"]), F.transform(use, lambda x: F.coalesce(F.substring(F.col(text), x["off_start"] + 1, x["off_end"] - x["off_start"]), F.lit("")))]

    b, r = side("ross_text", "ross_sents"), side("ref_text", "ref_sents")
    c = c.where("ross_text is not null").select("chapter_id", "ross_lang", "ref_lang", b[0].alias("b_ids"), b[1].alias("b"), r[0].alias("c_ids"), r[1].alias("c"))
    g = latest(gsents, "sent_id", "loaded_at", ["chapter_id", "seq", "lang", "text"]).where("chapter_id is not null")
    g = g.join(c.select("chapter_id"), "chapter_id", "left_semi")
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("seq", F.lit(1 << 30)).alias("seq"), "sent_id", F.coalesce("text", F.lit("")).alias("text"))))
    g = g.groupBy("chapter_id").agg(order.alias("g"), F.mode("lang").alias("a_lang"))
    g = g.select("chapter_id", "a_lang", F.transform("g", lambda x: x["sent_id"]).alias("a_ids"), F.transform("g", lambda x: x["text"]).alias("a"))
    return c.join(g, "chapter_id", "left")


SIDES = ("a", "b", "c")
CUT = "chapter_id long, " + ", ".join(f"{x}_lang string, {x}_ids array<long>, {x}_keys string, {x}_nums binary, {x}_length int" for x in SIDES)


def cut_up(rows: DataFrame) -> DataFrame:
    """Each chapter's three sides cut into words, once for all later passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def arr(x) -> list:
            return [] if x is None else list(x)

        for b in pieces(batches):
            out = []
            for r in b.itertuples():
                a = arr(r.a)
                told = r.a_lang if isinstance(r.a_lang, str) else "grc" if any("Ͱ" <= ch < "Ѐ" or "ἀ" <= ch < "\u2000" for s in a for ch in s) else "lat"
                b_lang, c_lang = (x if isinstance(x, str) else "en" for x in (r.ross_lang, r.ref_lang))
                sides = read(told, arr(r.a_ids), a), read("1" + b_lang, arr(r.b_ids), arr(r.b)), read("2" + c_lang, arr(r.c_ids), arr(r.c))
                out.append((r.chapter_id, *(v for x in sides for v in x.row())))
            yield record(pd.DataFrame(out, columns=["chapter_id", *(f"{x}_{c}" for x in SIDES for c in ("lang", "ids", "keys", "nums", "length"))]), CUT)

    return rows.mapInArrow(run, CUT)


def _bitexts(r) -> list[tuple[Side, Side]]:
    """The two bitexts of a chapter row: original with the first translation, that with the second."""
    a, b, c = (Side.of(*(getattr(r, f"{x}_{k}") for k in ("lang", "ids", "keys", "nums", "length"))) for x in SIDES)
    return [(x, y) for x, y in ((a, b), (b, c)) if x.ids and y.ids]


def _words(cuts: DataFrame) -> DataFrame:
    """(la, w, n, caps): sentences that hold each word, and in how many it is capitalised; w = '' counts the sentences."""

    made = "la string, w string, n long, caps long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[str, Counter] = defaultdict(Counter)
        caps: dict[str, Counter] = defaultdict(Counter)

        def rows() -> pa.RecordBatch:
            return record(pd.DataFrame([(la, w, k, caps[la][w]) for la, c in n.items() for w, k in c.items()], columns=["la", "w", "n", "caps"]), made)

        for b in pieces(batches):
            for r in b.itertuples():
                for side in (x for two in _bitexts(r) for x in two):
                    n[side.lang][""] += len(side.ids)
                    held = {(k, key): c for k, key, c in zip(side.sent, side.keys, side.name) if key[0] != "#"}
                    n[side.lang].update(key for _, key in held)
                    caps[side.lang].update(key for (_, key), c in held.items() if c)
            if sum(map(len, n.values())) > HELD // 4:
                yield rows()
                n.clear()
                caps.clear()
        yield rows()

    return cuts.mapInArrow(run, made).groupBy("la", "w").agg(F.sum("n").alias("n"), F.sum("caps").alias("caps"))


def _attach(cuts: DataFrame, words: DataFrame, links: DataFrame | None) -> DataFrame:
    """``cuts`` with the rows of the lexicon that each chapter needs: a chapter holds few words, whatever the lexicon's size."""
    parts = [cuts.select("chapter_id", F.col(f"{x}_lang").alias("la"), F.explode(F.array_distinct(F.split(f"{x}_keys", "\n"))).alias("w")) for x in SIDES]
    need = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("w <> ''")
    own = need.join(words, ["la", "w"]).groupBy("chapter_id").agg(F.collect_list(F.struct("la", "w", "n", "name")).alias("own_words"))
    out = cuts.join(own, "chapter_id", "left")
    if links is not None:
        hit = need.join(links, ["la", "w"]).join(need.select("chapter_id", F.col("la").alias("lb"), F.col("w").alias("v")), ["chapter_id", "lb", "v"], "left_semi")
        out = out.join(hit.groupBy("chapter_id").agg(F.collect_list(F.struct("la", "lb", "w", "v", "s")).alias("own_links")), "chapter_id", "left")
    return out


@dataclass
class Model:
    """A lexicon held whole, or (``whole`` is false) tables to join with each chapter."""

    lex: Lexicon
    words: DataFrame
    links: DataFrame | None = None
    whole: bool = True

    def rows(self, cuts: DataFrame) -> DataFrame:
        return cuts if self.whole else _attach(cuts, self.words, self.links)


def _few(df: DataFrame, limit: int) -> list[pa.Array] | None:
    """The columns, or None where there are more than ``limit`` rows; fetched by Arrow, as rows take many times the room."""
    got = df.limit(limit + 1).toArrow()
    return None if got.num_rows > limit else [c.combine_chunks() for c in got.columns]


def _tuples(columns: list[pa.Array] | None, step: int = 10_000) -> Iterator[tuple]:
    for k in range(0, len(columns[0]) if columns else 0, step):
        yield from zip(*(c.slice(k, step).to_pylist() for c in columns))


def _own(r, lex: Lexicon) -> Lexicon:
    """The lexicon of a row: the shared one, or that of the rows joined to it."""
    if not hasattr(r, "own_words"):
        return lex
    words, links = (x if (x := getattr(r, c, None)) is not None else () for c in ("own_words", "own_links"))
    return Lexicon(lex.sents, ((x["la"], x["w"], x["n"], x["name"]) for x in words), ((x["la"], x["lb"], x["w"], x["v"], x["s"]) for x in links))


def _fold(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each code once, in order, with its sum."""
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return code[first], np.add.reduceat(n, first)


class Tally:
    """Counts of pairs of words by pair of languages, in bounded room: pairs are folded into counts, and counts passed on when they are many."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.pending: dict[tuple[str, str], list[np.ndarray]] = defaultdict(list)
        self.counts: dict[tuple[str, str], tuple[np.ndarray, np.ndarray]] = {}
        self.size = 0

    def add(self, two: tuple[str, str], a: np.ndarray, b: np.ndarray) -> None:
        """All pairs of ``a`` with ``b``."""
        step = max(1, PENDING // len(b))
        for k in range(0, len(a), step):
            code = ((a[k : k + step, None] << 32) + b[None, :]).ravel()
            self.pending[two].append(code)
            self.size += len(code)
            if self.size >= PENDING:
                self.fold()

    def fold(self) -> None:
        for two, parts in self.pending.items():
            code = np.concatenate(parts)
            code, n = _fold(code, np.ones(len(code), dtype=np.int64))
            if two in self.counts:
                was = self.counts[two]
                code, n = _fold(np.concatenate([was[0], code]), np.concatenate([was[1], n]))
            self.counts[two] = code, n
        self.pending.clear()
        self.size = 0

    def full(self) -> bool:
        return sum(len(code) for code, _ in self.counts.values()) > HELD

    def rows(self, step: int = 50_000) -> Iterator[pd.DataFrame]:
        """What was counted, in pieces; then it begins anew."""
        self.fold()
        back = ["", *self.number]
        for (la, lb), (code, n) in self.counts.items():
            for k in range(0, len(code), step):
                c = code[k : k + step]
                w, v = [back[x] for x in (c >> 32).tolist()], [back[x] for x in (c & 0xFFFFFFFF).tolist()]
                yield pd.DataFrame({"la": la, "lb": lb, "w": w, "v": v, "n": n[k : k + step]})
        self.counts.clear()
        self.number.clear()


def learn(cuts: DataFrame, glosses: DataFrame) -> Model:
    """Word links over all chapters, by log-likelihood ratio of joint occurrence in sentence pairs about the diagonal.

    Words only ever written with a capital are names, which are told by their letters and
    need no link; in a language where many types are so written, capitals mark no names.
    """
    spark = cuts.sparkSession
    words = cut(_words(cuts))
    sents: dict[str, int] = {}
    per = words.groupBy("la").agg(
        F.sum(F.when(F.col("w") == "", F.col("n"))).alias("sents"),
        F.sum((F.col("n") >= TYPES).cast("int")).alias("types"),
        F.sum(((F.col("n") >= TYPES) & (F.col("caps") == F.col("n"))).cast("int")).alias("capital"),
    )
    marks = []
    for r in per.collect():
        sents[r["la"]] = r["sents"] or 0
        if r["capital"] <= CAPITALS * r["types"]:
            marks.append(r["la"])
    known = words.where("w <> '' and n > 1").select("la", "w", "n", ((F.col("caps") == F.col("n")) & F.col("la").isin(marks)).alias("name"))
    rows = _few(known, MOST_WORDS)
    lex = Lexicon(sents, _tuples(rows))
    model = Model(lex, known, None, rows is not None)
    shared = spark.sparkContext.broadcast(lex)
    pair = "la string, lb string, w string, v string, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in pieces(batches):
            for r in batch.itertuples():
                own = _own(r, shared.value)
                for x, y in _bitexts(r):
                    ids = []
                    for side in (x, y):
                        use: list[set] = [set() for _ in side.ids]
                        known, linkable = own.ids.get(side.lang, {}), own.linkable(side.lang)
                        for k, key in zip(side.sent, side.keys):
                            if (i := known.get(key)) is not None and linkable[i]:
                                use[k].add(tally.number.setdefault(key, len(tally.number)))
                        # Number 0 stands for the sentence itself, so that its products count totals and single words.
                        ids.append([np.array([-1, *sorted(u)], dtype=np.int64) + 1 for u in use])
                    for i, j in _near(len(x.ids), len(y.ids)):
                        tally.add((x.lang, y.lang), ids[0][i], ids[1][j])
                if tally.full():
                    yield from (record(b, pair) for b in tally.rows())
        yield from (record(b, pair) for b in tally.rows())

    n = cut(model.rows(cuts).mapInArrow(run, pair).groupBy("la", "lb", "w", "v").agg(F.sum("n").alias("n")))
    shared.destroy()
    keys = ["la", "lb"]
    all_ = n.where("w = '' and v = ''").select(*keys, F.col("n").alias("total"))
    ws = n.where("w <> '' and v = ''").select(*keys, "w", F.col("n").alias("nw"))
    vs = n.where("w = '' and v <> ''").select(*keys, "v", F.col("n").alias("nv"))
    both = n.where("w <> '' and v <> '' and n > 2")
    both = both.join(F.broadcast(all_), keys).join(ws, [*keys, "w"]).join(vs, [*keys, "v"])

    def ll(k, m, p):
        p = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
        return k * F.log(p) + (m - k) * F.log(1 - p)

    k1, n1, k2, n2 = F.col("n"), F.col("nw"), F.col("nv") - F.col("n"), F.col("total") - F.col("nw")
    p, p1, p2 = (k1 + k2) / (n1 + n2), k1 / n1, k2 / F.greatest(n2, F.lit(1))
    llr = 2 * (ll(k1, n1, p1) + ll(k2, n2, p2) - ll(k1, n1, p) - ll(k2, n2, p))
    scored = both.withColumn("llr", F.when(p1 > p2, llr).otherwise(0.0)).where(F.col("llr") > LINK_LLR)
    scored = scored.withColumn("best_w", F.max("llr").over(Window.partitionBy(*keys, "w"))).withColumn("best_v", F.max("llr").over(Window.partitionBy(*keys, "v")))
    kept = scored.where("llr >= 0.2 * best_w and llr >= 0.06 * best_v").select(*keys, "w", "v", (F.col("llr") / F.greatest("best_w", F.lit(1.0))).alias("s"))
    # The glosses are a table of fixed size.
    told = []
    for r in bounded(glosses.where("form is not null and lang is not null and gloss is not null").select("form", "lang", "gloss").distinct(), 1_000_000, "glosses"):
        for f in {fold(x) for x in _WORD.findall(r["form"])}:
            for v in {fold(x) for x in _WORD.findall(r["gloss"])}:
                if len(f) > 1 and len(v) > 2:
                    told.append((r["lang"], "1en", f, v, 0.8) if r["lang"] in ("grc", "lat") else ("1en", "2" + r["lang"], v, f, 0.8))
    told = sorted(set(told))
    listed = _few(kept, MOST_LINKS) if model.whole else None
    if listed is None:
        extra = spark.createDataFrame(told, "la string, lb string, w string, v string, s double")
        model.links = cut(kept.unionByName(extra).groupBy("la", "lb", "w", "v").agg(F.max("s").alias("s")))
        model.whole, model.lex = False, Lexicon(sents, ())
        return model
    model.lex = Lexicon(sents, _tuples(rows), chain(told, _tuples(listed)))
    return model


Point = tuple[float, float, float, int, int]


def points(a: Side, b: Side, lex: Lexicon, wa: list[float], wb: list[float]) -> list[Point]:
    """(x, y, weight, index of word a, index of word b)."""
    by: dict[str, list[int]] = defaultdict(list)
    names: dict[str, list[int]] = defaultdict(list)
    for k, key in enumerate(b.keys):
        if wb[k]:
            by[key].append(k)
            if b.name[k]:
                names[key].append(k)
    same = a.lang[-2:] == b.lang[-2:]
    out = []
    for k, key in enumerate(a.keys):
        if not wa[k]:
            continue
        hit: dict[int, float] = {}
        if key[0] == "#" or same:
            for q in by.get(key, ()):
                hit[q] = 1.0
        for v, s in lex.linked(a.lang, b.lang, key):
            if v in by:
                for q in by[v]:
                    hit[q] = max(hit.get(q, 0.0), min(1.0, 0.5 + s / 2))
        if a.name[k]:
            for q in names.get(latin(key) if a.lang == "grc" else key, ()):
                hit[q] = 1.0
        for q, s in hit.items():
            out.append((a.at[k], b.at[q], s * min(wa[k], wb[q]), k, q))
    return out


def tightest(pts: list[Point], ox: float, oy: float, slope: float, size: int, limit: float) -> list[Point]:
    """The chain of ``size`` points, all in different rows and columns, that lies closest about a line of the slope.

    [] where the least dispersal is above ``limit``. Points are taken in order of their
    displacement from the slope line through (ox, oy), ties by place.
    """
    near = sorted((y - oy - slope * (x - ox), x, y, w, p, q) for x, y, w, p, q in pts)
    best, chain = None, []
    for k in range(len(near) - size + 1):
        part = near[k : k + size]
        mean = sum(v[0] for v in part) / size
        spread_ = math.sqrt(sum((v[0] - mean) ** 2 for v in part) / size)
        if spread_ <= limit and len({v[1] for v in part}) == size and len({v[2] for v in part}) == size:
            key = spread_ + abs(mean) * 0.25
            if best is None or key < best:
                best, chain = key, part
    return [(x, y, w, p, q) for _, x, y, w, p, q in chain]


@dataclass
class Chain:
    """A chain's points and its rectangle, from the corner where the search began to the chain's own end."""

    points: list[Point]
    x0: float
    y0: float
    x1: float
    y1: float
    inverted: bool = False


def chains(pts: list[Point], width: float, height: float) -> list[Chain]:
    """Chains of points found by growing rectangles from the origin; a text's end takes what is left, from two points on."""
    slope = height / max(width, 1.0)
    pts = sorted(pts)
    xs = [p[0] for p in pts]
    ox = oy = -1.0
    out: list[Chain] = []
    while ox < width and oy < height:
        size, found = 90.0, []
        while not found:
            lo, hi = bisect.bisect_right(xs, ox), bisect.bisect_right(xs, ox + size)
            inside = [p for p in pts[lo:hi] if oy < p[1] <= oy + size * slope]
            rows, cols = Counter(p[1] for p in inside), Counter(p[0] for p in inside)
            # Points in crowded rows and columns are noise at this size.
            quiet = [p for p in inside if rows[p[1]] <= 2 and cols[p[0]] <= 2]
            limit = DISPERSAL * min(size * slope, 160.0)
            whole = ox + size >= width and oy + size * slope >= height
            for k in range(CHAIN, (1 if whole else CHAIN - 1), -1):
                if found := tightest(quiet, ox, oy, slope, k, limit):
                    break
            if whole and not found:
                return out
            size *= 1.4
        ex, ey = max(p[0] for p in found), max(p[1] for p in found)
        out.append(Chain(found, ox, oy, ex, ey))
        ox, oy = ex, ey
    return out


def inversions(a: Side, b: Side, pts: list[Point], slope: float, held: set[tuple[int, int]]) -> list[Chain]:
    """Chains beside the map: of two points or more in a rectangle of a clause by a clause that no chain's rectangle holds."""
    by: dict[tuple[int, int], list[Point]] = defaultdict(list)
    for p in pts:
        cell = a.clause[p[3]], b.clause[p[4]]
        if cell not in held:
            by[cell].append(p)
    out = []
    for _, part in sorted(by.items()):
        if len(part) < 2:
            continue
        x, y = min(p[0] for p in part), min(p[1] for p in part)
        tall = max(slope * (max(p[0] for p in part) - x), max(p[1] for p in part) - y)
        for k in range(min(CHAIN, len(part)), 1, -1):
            if got := tightest(part, x, y, slope, k, DISPERSAL * min(max(tall, 40.0), 160.0)):
                out.append(Chain(got, x, y, max(p[0] for p in got), max(p[1] for p in got), True))
                break
    return out


ON_MAP, OFF_MAP, LEAST, FEW = 0.46, 0.5, 4.0, 0.85


def align(a: Side, b: Side, lex: Lexicon) -> list[tuple[int, int, float]]:
    """Pairs of sentence indices with their score: blocks of the chains of a bitext."""
    wa, wb = weights(a, lex), weights(b, lex)
    pts = points(a, b, lex, wa, wb)
    width, height = max(a.length, 1), max(b.length, 1)
    slope = height / width
    found = chains(pts, width, height)
    if not found:
        return []
    # The clauses of a chain's rectangle, and those about its ends.
    held: set[tuple[int, int]] = set()
    for c in found:
        ca = [a.clause[min(max(bisect.bisect_left(a.at, x), 0), len(a.at) - 1)] for x in (c.x0, c.x1)]
        cb = [b.clause[min(max(bisect.bisect_left(b.at, y), 0), len(b.at) - 1)] for y in (c.y0, c.y1)]
        held.update((i, j) for i in range(ca[0] - 1, ca[1] + 2) for j in range(cb[0] - 1, cb[1] + 2))
    beside = {(a.clause[c.points[0][3]], b.clause[c.points[0][4]]) for c in inversions(a, b, pts, slope, held)}
    cells: dict[tuple[int, int], list] = defaultdict(list)
    for _, _, w, p, q in pts:
        cell = a.clause[p], b.clause[q]
        if cell in held or cell in beside:
            cells[cell].append((w, p, q))
    mass_a, mass_b = Counter(), Counter()
    for side, mass, ws in ((a, mass_a, wa), (b, mass_b, wb)):
        for w, c in zip(ws, side.clause):
            mass[c] += w
    used_a: set[int] = set()
    used_b: set[int] = set()

    def rate(cell: tuple[int, int]) -> tuple[float, float, list]:
        """The block's score, the weight of its points, and these: each word once, those that no other block holds."""
        got, seen_p, seen_q, pairs = 0.0, set(), set(), []
        for w, p, q in cells[cell]:
            if p not in used_a and q not in used_b and p not in seen_p and q not in seen_q:
                seen_p.add(p)
                seen_q.add(q)
                got += w
                pairs.append((p, q))
        return got / max(1e-9, min(mass_a[cell[0]], mass_b[cell[1]])) * (1.0 if cell in held else FEW), got, pairs

    heap = []
    for cell in sorted(cells):
        most = sum(v[0] for v in cells[cell])
        if most < LEAST or most < ON_MAP * min(mass_a[cell[0]], mass_b[cell[1]]) or len(cells[cell]) < 2:
            continue  # even with all its points the block falls short
        cells[cell].sort(key=lambda v: (-v[0], v[1], v[2]))
        score, got, _ = rate(cell)
        heap.append((-score * math.sqrt(got), cell))
    heapq.heapify(heap)
    home_a, home_b = dict(zip(a.clause, a.sent)), dict(zip(b.clause, b.sent))
    best: dict[tuple[int, int], float] = {}
    while heap:
        was, c = heapq.heappop(heap)
        score, got, pairs = rate(c)
        now = -score * math.sqrt(got)
        if now > was + 1e-9:
            if got >= LEAST:
                heapq.heappush(heap, (now, c))
            continue
        if score >= (ON_MAP if c in held else OFF_MAP) and got >= LEAST and (len(pairs) > 2 or len(pairs) == 2 and score >= FEW):
            pair = home_a[c[0]], home_b[c[1]]
            best[pair] = max(best.get(pair, 0.0), score)
            used_a.update(p for p, _ in pairs)
            used_b.update(q for _, q in pairs)
    return [(*k, v) for k, v in sorted(best.items())]


def pairs(cuts: DataFrame, model: Model) -> DataFrame:
    """(chapter_id, a, b, score) for the sentence pairs of both bitexts of each chapter."""
    shared = cuts.sparkSession.sparkContext.broadcast(model.lex)

    made = "chapter_id long, a long, b long, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out = []
            for r in batch.itertuples():
                lex = _own(r, shared.value)
                for x, y in _bitexts(r):
                    out += [(r.chapter_id, x.ids[i], y.ids[j], s) for i, j, s in align(x, y, lex)]
            yield record(pd.DataFrame(out, columns=["chapter_id", "a", "b", "score"]), made)

    return model.rows(cuts).mapInArrow(run, made)


def found(chapter_refs: DataFrame, gsents: DataFrame, glosses: DataFrame) -> DataFrame:
    """(sent_a, sent_b): pairs of sentences of a chapter that render a statement in common, smaller id first."""
    cuts = cut(cut_up(chapters(chapter_refs, gsents)))
    return pairs(cuts, learn(cuts, glosses)).select(F.least("a", "b").alias("sent_a"), F.greatest("a", "b").alias("sent_b")).distinct()
