"""Sentence boundaries learned without supervision, per language.

First pass: for every type, how often it stands with and without a final period gives a
log-likelihood ratio, scaled by length and inner periods; types above the threshold are
abbreviations, and which words are usual in lower case (their capital marks a sentence
start). Second pass: a log-likelihood ratio of each word's rate behind sure breaks against
its rate elsewhere gives the sentence starters. Third pass: what follows each
abbreviation, or each pair of a word and an initial; a log-likelihood ratio over the
followers tells whether a name after it belongs to it (a collocation) or starts a
sentence. Every period is then classified with these statistics; other signs, quotations, brackets, unspaced scripts and
inscriptions follow their own rules.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import repeat

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TooLarge, bounded, cut

ABBREVIATION = 0.3
ENOUGH = 500
COLLOCATION = 7.88
#: Ratio from which a word is a sentence starter; counted as from at most so many breaks, as the ratio grows with the corpus.
STARTER, ENOUGH_BREAKS = 30.0, 20_000
#: Up to these rows the statistics are sent to every task; beyond, each text gets the rows it needs by a join.
MOST_STATS = 400_000

# Signs.
OPEN, CLOSE = "([{（［", ")]}）］"
QUOTES = {"“": "”", "„": "“", "«": "»", "‹": "›", "「": "」", "『": "』", "‚": "‘"}
CLOSERS = "”»›」』“‘’\"'" + CLOSE
STOPS = ".!?…。！？｡．‥‽"
GREEK_QUESTION = ";;"
PARTING = "⁝⁞:·⁚⁖⁘᛫․.·"
CJK = ("zh", "ja")


_GREEK, _KANA, _HAN = re.compile("[Ͱ-Ͽἀ-῿]"), re.compile("[\u3040-\u30ff]"), re.compile("[\u2e80-\u303f\u3400-\u9fff\uf900-\ufaff]")
_INVISIBLE = re.compile("[" + "".join(re.escape(chr(c)) for c in (*range(0xD800), *range(0xE000, 0x10000), *range(0x1D173, 0x1D17B), *range(0xE0000, 0xE0080)) if unicodedata.category(chr(c)) == "Cf") + "]")


def script(text: str) -> str | None:
    """The language where the script alone tells it."""
    if text.isascii():
        return None
    grc, kana, han = (sum(map(str.isalpha, p.findall(text))) for p in (_GREEK, _KANA, _HAN))
    letters = sum(map(str.isalpha, text))
    if not letters:
        return None
    if kana + han > 0.4 * letters:
        return "ja" if kana else "zh"
    return "grc" if grc > letters - grc - kana - han else None


def visible(text: str) -> tuple[str, Sequence[int]]:
    """The text without invisible characters, and the place of each character."""
    if text.isascii() or not _INVISIBLE.search(text):
        return text, range(len(text))
    at = [i for i, ch in enumerate(text) if not _INVISIBLE.match(ch)]
    return "".join(text[i] for i in at), at


@lru_cache(60_000)
def word_type(w: str) -> str:
    return unicodedata.normalize("NFC", w).lower()


@dataclass
class Model:
    """Statistics of all languages; small, as filtered by significance."""

    abbreviations: dict[str, set[str]] = field(default_factory=dict)
    common: dict[str, set[str]] = field(default_factory=dict)
    attached: dict[str, set[str]] = field(default_factory=dict)
    starters: dict[str, set[str]] = field(default_factory=dict)
    words: dict[str, dict[str, float]] = field(default_factory=dict)

    @staticmethod
    def of(rows) -> Model:
        """From rows (lang, kind, key, weight)."""
        m = Model()
        for r in rows:
            if r["kind"] == "words":
                m.words.setdefault(r["lang"], {})[r["key"]] = r["weight"]
            else:
                getattr(m, r["kind"]).setdefault(r["lang"], set()).add(r["key"])
        return m

    def language(self, text: str, told: str | None) -> str:
        if (s := script(text)) is not None:
            return s
        if told and told not in (*CJK, "grc"):
            return told
        seen = [word_type(w.strip(".,;:!?()“”\"'«»„")) for w in text.split()]
        best = {lang: sum(p.get(w, 0.0) for w in seen) for lang, p in self.words.items()}
        return max(sorted(best), key=lambda k: best[k]) if best and max(best.values()) > 0 else (told or "")


_TOKEN = re.compile(r"\S+")


def tokens(s: str) -> Iterator[tuple[str, int, int]]:
    """(token, start, end) of what white space parts."""
    for m in _TOKEN.finditer(s):
        yield m[0], m.start(), m.end()


@lru_cache(60_000)
def _core(tok: str) -> str:
    a, b = 0, len(tok)
    while a < b and not tok[a].isalnum():
        a += 1
    while b > a and not (tok[b - 1].isalnum() or tok[b - 1] == "." or unicodedata.combining(tok[b - 1])):
        b -= 1
    return tok[a:b]


def _count_types(lang: str, text: str, model: Model | None, out: Counter) -> None:
    for tok, _, _ in tokens(visible(text)[0]):
        core = _core(tok)
        bare = core.rstrip(".")
        if not bare:
            continue
        if not any(ch.isalpha() for ch in bare):
            out[lang, "n", "", core.endswith(".")] += 1
            continue
        out[lang, "w", word_type(bare), core.endswith(".")] += 1
        first = bare[0]
        out[lang, "lower" if first.islower() else "upper", word_type(bare), False] += 1


def _pieces(tok: str) -> str:
    """Class of what comes next: its first letter or digit behind opening signs."""
    for ch in tok:
        if ch.isalpha():
            return "U" if ch.isupper() else "l"
        if ch.isdigit():
            return "d"
    return "-"


def _key(prev: str, bare: str) -> str:
    """What the followers are counted for: an abbreviation, or a single capital with the word before it."""
    return f"{prev} #" if len(bare) == 1 and bare.isupper() else f"{prev} 0" if bare.isdigit() else word_type(bare)


def _is_name(nxt: str, common: set[str], starters: set[str]) -> bool:
    """Of a capitalised token: a name, or an initial, rather than a word capitalised as it starts a sentence."""
    core = _core(nxt)
    bare = core.rstrip(".")
    if len(bare) == 1 and core.endswith("."):
        return True
    return word_type(bare) not in common and word_type(bare) not in starters


def _count_starters(lang: str, text: str, model: Model, out: Counter) -> None:
    toks = list(tokens(visible(text)[0]))
    short = model.abbreviations.get(lang, set())
    for (tok, _, _), (nxt, _, _) in zip(toks, toks[1:]):
        core = _core(tok)
        bare = core.rstrip(".")
        if len(core) - len(bare) != 1 or tok[-1] in ",;:" or not bare or bare.isdigit() or word_type(bare) in short or len(bare) == 1:
            continue
        word = word_type(_core(nxt).rstrip("."))
        out[lang, "plain", "", ""] += 1
        if word and _pieces(nxt) in "Ul":
            out[lang, "starter", word, ""] += 1


def _count_context(lang: str, text: str, model: Model, out: Counter) -> None:
    toks = list(tokens(visible(text)[0]))
    common, short = model.common.get(lang, set()), model.abbreviations.get(lang, set())
    starters = model.starters.get(lang, set())
    for i, (tok, _, _) in enumerate(toks):
        core = _core(tok)
        bare = core.rstrip(".")
        if i + 1 == len(toks) or not bare or len(core) - len(bare) != 1 or tok[-1] in ",;:":
            continue
        nxt = toks[i + 1][0]
        kind = _pieces(nxt)
        what = "on" if kind != "U" else "name" if _is_name(nxt, common, starters) else "start"
        prev = word_type(_core(toks[i - 1][0]).rstrip(".")) if i else ""
        if word_type(bare) in short or len(bare) == 1 and bare.isupper() or bare.isdigit():
            out[lang, "after", _key(prev, bare), what] += 1
        else:
            out[lang, "plain", "", what] += 1


def _needs(text: str) -> set[str]:
    """All keys under which the statistics of a text's words can stand."""
    out, prev = set(), ""
    for tok in [*text.split(), *(t for t, _, _ in tokens(visible(text)[0]))]:
        core = _core(tok)
        bare = core.rstrip(".")
        out |= {word_type(bare), word_type(tok.strip(".,;:!?()“”\"'«»„")), _key(prev, bare) if bare else ""}
        out |= {word_type(x) for x in (*core.split("."), core)}
        prev = word_type(bare)
    return out


def _run(rows: DataFrame, table: DataFrame | None, one, schema: str) -> DataFrame:
    """``one(batch, model of each row)`` over rows (id, lang, text), with the statistics of ``table`` (lang, kind, key, weight)."""
    columns = [c.split()[0] for c in schema.split(", ")]
    rows = rows.select("id", "lang", "text")
    try:
        shared = rows.sparkSession.sparkContext.broadcast(Model.of(bounded(table, MOST_STATS, "statistics")) if table is not None else None)
    except TooLarge:
        shared = None
        rows = rows.withColumn("h", F.xxhash64("text"))

        def need(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame([(h, k) for h, t in zip(b["h"], b["text"]) for k in _needs(t) if k], columns=["h", "key"])

        keys = rows.select("h", "text").mapInPandas(need, "h long, key string").distinct()
        own = keys.join(table, "key").groupBy("h").agg(F.collect_list(F.struct("lang", "kind", "key", "weight")).alias("own"))
        rows = rows.join(own, "h", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            models = repeat(shared.value) if shared is not None else (Model.of(x if x is not None else ()) for x in b["own"])
            yield pd.DataFrame(one(b, models), columns=columns)

    return rows.mapInPandas(run, schema)


def _counts(texts: DataFrame, one, table: DataFrame | None) -> DataFrame:
    """Sums of ``one`` over all texts: counted by batch, then merged with a partial aggregate."""

    def count(b: pd.DataFrame, models) -> list:
        n: Counter = Counter()
        for lang, text, model in zip(b["lang"], b["text"], models):
            told = lang if isinstance(lang, str) else None
            known = model.language(text, told) if model else script(text) or told
            if known and known not in CJK:
                one(known, text, model, n)
        return [(*map(str, k), v) for k, v in n.items()]

    return _run(texts, table, count, "lang string, kind string, a string, b string, n long").groupBy("lang", "kind", "a", "b").agg(F.sum("n").alias("n"))


def _ratio(k1, n1, k2, n2):
    """Dunning's log-likelihood ratio of two binomials as a column, signed: positive if the first rate is higher."""

    def ll(k, n, p):
        return F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(n - k > 0, (n - k) * F.log(1 - p)).otherwise(0.0)

    p, p1, p2 = (k1 + k2) / (n1 + n2), k1 / n1, k2 / n2
    ratio = 2 * (ll(k1, n1, p1) + ll(k2, n2, p2) - ll(k1, n1, p) - ll(k2, n2, p))
    some = (n1 > 0) & (n2 > 0) & (k1 + k2 > 0) & (k1 + k2 < n1 + n2)
    return F.when(~some, 0.0).when(p1 >= p2, ratio).otherwise(-ratio)


def train(texts: DataFrame) -> DataFrame:
    """Statistics (lang, kind, key, weight) over all texts (id, lang, text); texts of unknown language do not count in the first pass."""
    texts = texts.where("text <> ''").select("id", "lang", "text")
    first = cut(_counts(texts, _count_types, None))
    both = first.where("kind in ('w', 'n')").groupBy("lang", "kind", "a").agg(
        F.sum(F.when(F.col("b") == "True", F.col("n")).otherwise(0)).alias("dot"), F.sum("n").alias("all")
    )
    total = both.groupBy("lang").agg(F.sum("dot").alias("dots"), F.sum("all").alias("total"))
    w = both.where("kind = 'w' and dot > 1").join(F.broadcast(total), "lang")
    # Log-likelihood that the period belongs to the type (rate 0.99) against the language's rate.
    p = F.greatest(F.least(F.col("dots") / F.col("total"), F.lit(0.98)), F.lit(1e-6))
    # Rates count as from at most ENOUGH occurrences: else, in a large corpus, any word that always ends sentences would pass.
    scale = F.least(F.lit(1.0), F.lit(float(ENOUGH)) / F.col("all"))
    free = F.col("all") - F.col("dot")
    llr = -2 * (F.col("dot") * F.log(p) + free * F.log(1 - p) - F.col("dot") * F.log(F.lit(0.99)) - free * F.log(F.lit(0.01))) * scale
    inner = F.length(F.regexp_replace("a", r"[^.]", ""))
    size = F.greatest(F.lit(1), F.length(F.regexp_replace("a", r"[.\p{M}]", "")))
    scored = w.withColumn("score", llr * F.exp(-size) * (inner + 1) * F.pow(size.cast("double"), -free.cast("double")))
    one = F.lit(1.0)

    def kind(name: str, df: DataFrame, weight=one) -> DataFrame:
        return df.select("lang", F.lit(name).alias("kind"), F.col("a").alias("key"), weight.alias("weight"))

    short = kind("abbreviations", scored.where(F.col("score") >= ABBREVIATION))
    case = first.where("kind in ('lower', 'upper')").groupBy("lang", "a").agg(
        F.sum(F.when(F.col("kind") == "lower", F.col("n")).otherwise(0)).alias("lower"), F.sum("n").alias("all")
    )
    usual = case.join(F.broadcast(total.select("lang", "total")), "lang").where("lower >= 0.2 * all and lower > 1")
    # Words that tell a language: one in ten thousand or more, each by its share among the languages.
    telling = usual.where("lower >= 1e-4 * total").withColumn("rate", F.col("lower") / F.col("total"))
    share = telling.withColumn("share", F.col("rate") / F.sum("rate").over(Window.partitionBy("a"))).where(~F.col("lang").isin("grc", *CJK))
    table = cut(short.unionByName(kind("common", usual)).unionByName(kind("words", share, F.col("share"))))
    second = cut(_counts(texts, _count_starters, table))
    breaks = second.where("kind = 'plain'").groupBy("lang").agg(F.sum("n").alias("breaks")).join(total, "lang")
    after = second.where("kind = 'starter'").groupBy("lang", "a").agg(F.sum("n").alias("n")).join(F.broadcast(breaks), "lang").join(both.where("kind = 'w'").select("lang", "a", "all"), ["lang", "a"])
    n, b = F.col("n").cast("double"), F.col("breaks").cast("double")
    lift = _ratio(n, b, F.greatest(F.col("all") - n, F.lit(0.0)), F.greatest(F.col("total") - b, F.lit(1.0)))
    starters = after.where(lift * F.least(F.lit(1.0), ENOUGH_BREAKS / b) >= STARTER)
    table = cut(table.unionByName(kind("starters", starters)))
    third = cut(_counts(texts, _count_context, table))
    what = [F.coalesce(F.sum(F.when(F.col("b") == x, F.col("n"))), F.lit(0)).cast("double").alias(x) for x in ("name", "start", "on")]
    plain = third.where("kind = 'plain'").groupBy("lang").agg(*[x.alias(f"all_{y}") for x, y in zip(what, ("name", "start", "on"))])
    ties = third.where("kind = 'after'").groupBy("lang", "a").agg(*what).join(F.broadcast(plain), "lang", "left").na.fill(0.0)
    tied = _ratio(F.col("name"), F.col("name") + F.col("start"), F.col("all_name"), F.col("all_name") + F.col("all_start")) >= COLLOCATION
    number = F.col("a").endswith(" 0")
    # A number: an ordinal only where names follow it far more than sentences do.
    held = F.when(number, tied & (F.col("name") > 5 * F.col("start"))).otherwise((tied & (F.col("name") > F.col("start"))) | ((F.col("on") > 0) & (F.col("start") == 0) & (F.col("name") <= F.col("on"))))
    ties = cut(ties.select("lang", "a", "on", held.alias("held")))
    # Only ever before a capital, as at any sentence's end: a word, not an abbreviation.
    words = ties.where("not held and on = 0 and not endswith(a, ' 0') and not contains(a, '.')").select("lang", F.lit("abbreviations").alias("kind"), F.col("a").alias("key"))
    return cut(table.join(words, ["lang", "kind", "key"], "left_anti").unionByName(kind("attached", ties.where("held"))))


def _pairs(s: str, lang: str) -> dict[int, int]:
    """Matched quotations and brackets: place of the opening sign to that of the closing one."""
    out: dict[int, int] = {}
    i, n = 0, len(s)
    stack: list[tuple[str, int]] = []
    plain: int | None = None
    for i, ch in enumerate(s):
        if ch == '"':
            if plain is None:
                plain = i
            else:
                out[plain] = i
                plain = None
        elif stack and ch == stack[-1][0]:
            out[stack.pop()[1]] = i
        elif ch in QUOTES:
            stack.append((QUOTES[ch], i))
        elif ch in OPEN:
            stack.append((CLOSE[OPEN.index(ch)], i))
        elif ch in CLOSE:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == ch:
                    out[stack[k][1]] = i
                    del stack[k:]
                    break
    return out


def inscription(s: str) -> bool:
    letters = [ch for ch in s if ch.isalpha()]
    return len(letters) >= 10 and all(not ch.islower() for ch in letters) and any(ch.isupper() for ch in letters) and len(s.split()) <= 1 + len(letters) // 25


def _ends(s: str, lang: str, model: Model) -> list[int]:
    """Places behind which a sentence ends, within the visible text."""
    n = len(s)
    if inscription(s) and lang not in CJK:
        ends, i = [], 0
        while i < n:
            if s[i] in PARTING + "!?;…":
                while i + 1 < n and (s[i + 1] in PARTING or s[i + 1] in CLOSERS):
                    i += 1
                ends.append(i + 1)
            i += 1
        return ends
    pairs, ends = _pairs(s, lang), []
    short, common = model.abbreviations.get(lang, set()), model.common.get(lang, set())
    attached, starters = model.attached.get(lang, set()), model.starters.get(lang, set())
    stops = STOPS + (GREEK_QUESTION if lang == "grc" else "")

    def follow(k: int) -> tuple[int, str, str]:
        """The first letter or digit after k, its class, and its token."""
        j = k
        while j < n and not (s[j].isalnum()):
            j += 1
        e = j
        while e < n and not s[e].isspace() and s[e] not in ",;:()":
            e += 1
        return j, (_pieces(s[j]) if j < n else "-"), s[j:e]

    def before(k: int) -> tuple[str, str, int]:
        """The token that ends before k, the word before it, and the token's start."""
        b = k
        while b > 0 and not s[b - 1].isspace() and s[b - 1] not in "(“„«\"[":
            b -= 1
        p = b
        while p > 0 and (s[p - 1].isspace() or s[p - 1] in "(“„«\"["):
            p -= 1
        q = p
        while q > 0 and not s[q - 1].isspace():
            q -= 1
        return s[b:k], word_type(_core(s[q:p]).rstrip(".")), b

    i = 0
    while i < n:
        ch = s[i]
        if i in pairs:
            j = pairs[i]
            if ch in OPEN:
                i = j + 1
                continue
            inside = s[i + 1 : j].rstrip()
            stopped = bool(inside) and inside[-1] in stops
            k = j + 1
            if not stopped or lang in CJK:
                i = k
                continue
            lead = s[:i].rstrip()
            told = bool(lead) and lead[-1] in ":··"
            at, kind, nxt = follow(k)
            word = word_type(_core(nxt).rstrip("."))
            rest = s[k:at]
            if any(x in rest for x in ",;" if x not in (GREEK_QUESTION if lang == "grc" else "")):
                pass
            elif rest[:1] and rest[0] in stops:
                i = k
                continue  # the stop behind the quotation decides
            elif at >= n or kind == "U" or (told and (kind == "d" or lang == "grc" and word in starters)):
                ends.append(k)
            i = k
            continue
        if ch not in stops:
            i += 1
            continue
        # The whole run of stops, with spaced dots.
        j = i + 1
        while j < n and (s[j] in stops or s[j] == " " and ch in ".…" and j + 1 < n and s[j + 1] == "." and s[j - 1] == "."):
            j += 1
        run = s[i:j].replace(" ", "")
        k = j
        while k < n and s[k] in CLOSERS and k not in pairs and not (s[k] == "'" and k + 1 < n and s[k + 1].isalnum()):
            k += 1
        if lang in CJK:
            if any(x in "。！？｡!?" for x in run) or run == "." and (k >= n or s[k].isspace()):
                ends.append(k)
            i = k
            continue
        at, kind, nxt = follow(k)
        word = word_type(_core(nxt).rstrip("."))
        gap = s[k:at]
        if at >= n:
            ends.append(k)
            i = max(k, at)
            continue
        if gap[:1] and gap[0] in ",;:)":
            i = k
            continue
        end = False
        spaced = bool(gap) and any(x.isspace() for x in gap)
        dots = set(run) <= set(".…‥")
        if dots and (len(run) > 1 or run in "…‥"):
            end = spaced and kind == "U"
        elif not dots:
            end = (kind != "l" or lang == "grc") and (spaced or kind == "U")
        else:
            tok, prev, b = before(i)
            bare = _core(tok + ".").rstrip(".")
            kin = word_type(bare)
            if not spaced:
                # Numbers and abbreviations hold inner periods; a lost space stands behind a word.
                end = kind != "d" and len(bare.rpartition(".")[2]) >= 3 and kin not in short and (kind == "U" or lang == "grc") or bare.isdigit() and kind == "U"
                end = end and len(word) > 1 or end and lang == "grc"
            else:
                initial = len(bare) == 1 and bare.isupper()
                if kind == "d":
                    end = kin not in short and (len(bare) > 3 or bare.isdigit())
                elif kin not in short and not initial:
                    end = kind != "l" or lang == "grc"
                    if bare.isdigit() and kind == "U":
                        end = not (_key(prev, bare) in attached and _is_name(nxt, common, starters))
                    if kind == "l" and lang == "grc" and "." in bare:
                        end = word in starters
                elif kind == "U":
                    end = not _is_name(nxt, common, starters) or _key(prev, bare) not in attached
                elif kind == "l" and lang == "grc":
                    key = _key(prev, bare)
                    end = word in starters and key not in attached and "." in bare
        if end:
            ends.append(k)
        i = k if k > i else i + 1
    return ends


def split(text: str, lang: str | None, model: Model) -> list[tuple[int, int]]:
    """Half-open code-point offsets of the sentences of a text as stored."""
    s, at = visible(text)
    lang = model.language(s, lang)
    cuts = [0, *_ends(s, lang, model), len(s)]
    out = []
    for a, b in zip(cuts, cuts[1:]):
        while a < b and s[a].isspace():
            a += 1
        while b > a and s[b - 1].isspace():
            b -= 1
        if a < b:
            if out and not any(ch.isalnum() for ch in s[a:b]):
                out[-1] = (out[-1][0], at[b - 1] + 1)
            else:
                out.append((at[a], at[b - 1] + 1))
    return out


def units(rows: DataFrame, table: DataFrame) -> DataFrame:
    """(id, unit_no, unit_start, unit_end) of rows (id, lang, text).

    Null, empty and blank texts have no unit; a text without any stop is one. A null
    language is told from script and common words. Each text is split by itself.
    """

    def cut_up(b: pd.DataFrame, models) -> list:
        return [(i, k, u, v) for i, lang, text, m in zip(b["id"], b["lang"], b["text"], models) for k, (u, v) in enumerate(split(text, lang if isinstance(lang, str) else None, m))]

    return _run(rows.where("id is not null and text <> ''"), table, cut_up, "id long, unit_no int, unit_start int, unit_end int")


def gsent_rows(gsents: DataFrame) -> DataFrame:
    from .common import latest

    return latest(gsents, "sent_id", "loaded_at", ["lang", "text"]).select(F.col("sent_id").alias("id"), "lang", "text")


def found(gsents: DataFrame) -> DataFrame:
    rows = cut(gsent_rows(gsents))
    return units(rows, train(rows)).select(F.col("id").alias("sent_id"), "unit_start", "unit_end")
