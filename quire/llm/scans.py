"""Repair of text from scanned pages by an averaged-perceptron character editor.

The editor gives each character an operation: keep, replace, delete, insert after, join
lines, or remove as furniture (running head, page number). Its features are characters
about it, the corpus' word counts with the best reading of a word they know, what a
mark at a line's end would join, and where the printed line stands and whether it holds
a title or author. It is trained on corrections (what the print shows beside what is
to stand), once with and once without the sight of the mended text. Operations of
adjacent characters are decoded together; the sign that replaces or is put in is
predicted by a second perceptron of the same kind.
"""

from __future__ import annotations

import difflib
import random
import re
import textwrap
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut, latest, spread

#: Bound of the training sample, in corrections chosen by a hash of the id.
SAMPLE, EPOCHS = 4000, 6
MOST_WORDS = 1_000_000
TAGS = "KRDIJHP"
MARKS = "-¬=­‐"
FOLDS = {"rn": "m", "cl": "d", "vv": "w", "li": "h", "ri": "n", "ii": "u"}

# Customs of spelling that are no misreading.
CUSTOMS = [("our", "or"), ("re", "er"), ("is", "iz"), ("ll", "l"), ("ae", "e"), ("oe", "e"), ("ence", "ense"), ("ogue", "og"), ("ph", "f"), ("ey", "ay")]
ROMAN = re.compile(r"[ivxlcIVXLC]+$")
NUMBER = re.compile(r"[\dOolIS]*\d[\dOolIS]*$|l[0Ool]{1,2}l?$")
LEAD = ("p", "pp", "cf", "vol", "fr", "s", "no", "ca", "year", "jahr", "an", "anno", "v", "bd", "within", "of", "about", "are", "after")


def custom(a: str, b: str) -> bool:
    return any(a.replace(x, y) == b or b.replace(x, y) == a for x, y in CUSTOMS) and a != b


@lru_cache(200_000)
def edits(a: str, b: str) -> int:
    """Edits between words, a pair of signs read as one and the reverse counting once; 3 means three or more."""
    best = _osa(a, b)
    for x, y in FOLDS.items():
        if x in a and y in b:
            best = min(best, 1 + _osa(a.replace(x, y, 1), b)) if best > 1 else best
        if y in a and x in b:
            best = min(best, 1 + _osa(a.replace(y, x, 1), b)) if best > 1 else best
    return best


def _osa(a: str, b: str) -> int:
    if abs(len(a) - len(b)) > 2:
        return 3
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return min(3, last[-1])


@dataclass
class Lexicon:
    """Counts of lower-cased words of the corpus, and an index of the frequent ones by deletions."""

    count: dict[str, int]
    total: int
    index: dict[str, list[str]] = field(default_factory=dict)
    memo: dict[str, tuple[str, int]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.frequent = max(5, self.total // 200_000)
        for w, n in self.count.items():
            if n >= self.frequent and 1 < len(w) < 20:
                for d in self._cuts(w):
                    self.index.setdefault(d, []).append(w)

    @staticmethod
    def _cuts(w: str) -> set[str]:
        return {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}

    def bin(self, w: str) -> int:
        n = self.count.get(w.lower(), 0)
        return 0 if n == 0 else 1 if n < self.frequent else 2 if n < 20 * self.frequent else 3

    def best(self, w: str) -> tuple[str, int]:
        """The frequent word that a rare one most likely stands for, and how sure; ("", 0) if none."""
        w = w.lower()
        if w in self.memo:
            return self.memo[w]
        own = self.count.get(w, 0)
        forms = {w}
        for x, y in FOLDS.items():
            for p, q in ((x, y), (y, x)):
                k = w.find(p)
                while k >= 0:
                    forms.add(w[:k] + q + w[k + len(p) :])
                    k = w.find(p, k + 1)
        plain = re.sub(r"[^\w]", "", w)
        forms.add(plain)
        got: dict[str, int] = {}
        for f in forms:
            for d in self._cuts(f) if len(f) < 24 else ():
                for c in self.index.get(d, ()):
                    if c != w and c not in got:
                        got[c] = edits(w, c)
        pick = ("", 0)
        limit = 1 if len(w) < 5 else 2
        few = [(n, -self.count[c], c) for c, n in got.items() if n <= limit and self.count[c] >= 20 * (own + 1) and not custom(w, c)]
        if few:
            n, k, c = min(few)
            pick = (c, 1 + (-k >= 200 * (own + 1)) + (n == 1))
        if len(self.memo) > 300_000:
            self.memo.clear()
        self.memo[w] = pick
        return pick


@dataclass
class Token:
    start: int
    end: int
    raw: str
    core: str
    at: int
    line: int


def read_tokens(text: str) -> tuple[list[Token], list[tuple[int, int]]]:
    """Tokens with their printed line; lines part at breaks and at wide gaps."""
    lines, k = [], 0
    for m in re.finditer(r"\s*\n\s*| {2,}|\t+", text):
        if _spread(text[k : m.start()], text[m.end() : m.end() + 2]) and "\n" not in m[0]:
            continue
        lines.append((k, m.start()))
        k = m.end()
    lines.append((k, len(text)))
    toks = []
    for n, (a, b) in enumerate(lines):
        for m in re.finditer(r"\S+", text[a:b]):
            raw = m[0]
            x, y = 0, len(raw)
            while x < y and not raw[x].isalnum():
                x += 1
            while y > x and not raw[y - 1].isalnum():
                y -= 1
            toks.append(Token(a + m.start(), a + m.end(), raw, raw[x:y], a + m.start() + x, n))
    return toks, lines


def _spread(before: str, after: str) -> bool:
    """Wide gaps within letters set apart part words, not lines."""
    return bool(re.search(r"(?:^|\s)\w \w$|^\w$", before)) and bool(re.match(r"\w(?: |$)", after))


@dataclass
class Heads:
    """Running heads of a work: the words of its title and author."""

    words: frozenset[str]
    joined: tuple[str, ...]


def heads(author: str | None, title: str | None) -> Heads:
    names = [re.sub(r"\W+", " ", x).strip().lower() for x in (author, title) if isinstance(x, str)]
    return Heads(frozenset(w for n in names for w in n.split()), tuple(n.replace(" ", "") for n in names if n))


def line_kind(text: str, head: Heads) -> str:
    """What a printed line looks like: set apart, capitals, bracketed, a number alone; and whether it names the work."""
    s = text.strip()
    words = re.findall(r"[^\W\d_]+", s)
    letters = "".join(words)
    if not letters:
        return "num" if any(c.isdigit() for c in s) and len(s) < 14 else "sign"
    single = sum(len(w) == 1 for w in words)
    if len(words) == 1 and ROMAN.match(words[0]) and words[0].islower() and len(s) < 10:
        return "rom"
    if re.fullmatch(r"[\[(]?\s*(?:p|pp|S|pag)\.\s*[\dOolIS]+\s*[\])]?", s) or NUMBER.fullmatch(s.strip("[]()-—*. ")):
        return "num"
    flat = letters.lower()
    named = any(len(j) > 5 and (j in flat or difflib.SequenceMatcher(None, j, flat, autojunk=False).find_longest_match(0, len(j), 0, len(flat)).size >= max(5, 0.45 * len(j))) for j in head.joined)
    caps = sum(c.isupper() for c in letters) / len(letters)
    own = sum(w.lower() in head.words or any(len(w) > 4 and edits(w.lower(), x) < 2 for x in head.words if len(x) > 4) or bool(re.fullmatch(r"(?i)book|bk|ch|cap|lib|[ivxlc]+", w)) for w in words)
    if own >= 3 and own >= 0.8 * len(words) and single < 5:
        return "full+"
    style = "sp" if single >= 5 and single > 0.7 * len(words) and caps > 0.5 else "up" if caps > 0.75 and len(letters) > 5 else "br" if s[0] in "[(" and s[-1] in "])" else "mid" if "·" in s else "lo"
    return style + ("+" if named else "-")


def features(text: str, nxt: str | None, head: Heads, lex: Lexicon, mended: dict[int, str] | None, cut_start: bool = False) -> Iterator[tuple[int, list[str], str | None]]:
    """(place, features, sign that the lexicon's reading would put there) of each character that is open to question; all others are kept.

    ``cut_start``: the first word may be the end of one.
    """
    toks, lines = read_tokens(text)
    kinds = [line_kind(text[a:b], head) for a, b in lines]
    many = len(lines)
    after_text = re.findall(r"\S+", nxt)[:1] if isinstance(nxt, str) else []
    caps_run = _title_runs(toks, head)
    for i, t in enumerate(toks):
        kind = kinds[t.line]
        place = "only" if many == 1 else "first" if t.line == 0 else "last" if t.line == many - 1 else "in"
        prev = toks[i - 1] if i else None
        follow = toks[i + 1] if i + 1 < len(toks) else None
        core = t.core
        low = core.lower()
        is_num = bool(core) and (core[0].isdigit() or bool(NUMBER.match(core)))
        roman = bool(core) and bool(ROMAN.match(core)) and (kind == "rom" or kind[:2] in ("up", "br", "mi", "sp", "fu"))
        b = lex.bin(core) if core.isalpha() else 0
        mixed = bool(re.search(r"[^\W\d_].*[^\w'’\-].*[^\W\d_]|[^\W\d_]\d|\d[^\W\d_]", core)) or bool(core) and bool(re.search(r"[~+|!^*#{(•<>]$|^[~+|!^*{•]", t.raw.rstrip(".,;:?")))
        furniture = kind[:2] in ("nu", "ro", "up", "sp") or kind in ("br+", "mid+", "full+") or t.start in caps_run
        guess, sure = ("", 0)
        if core and not is_num and not furniture and (b < 3 or mixed) and len(core) > 1:
            guess, sure = lex.best(t.raw.strip(".,;:?()[]\"“”") if mixed else core)
            if core[0].isupper() and not mixed and (b or edits(low, guess) > 1 or sure < 3) and i:
                guess, sure = "", 0
        split = ""
        if follow and core and follow.core and t.end == t.at + len(core) and follow.at == follow.start and core[-1:].isalpha() and follow.core[:1].islower():
            one = low + follow.core.lower()
            nb = lex.bin(follow.core)
            n1, n2, n = lex.count.get(low, 0), lex.count.get(follow.core.lower(), 0), lex.count.get(one, 0)
            if lex.bin(one) >= 2 and n > 3 * min(n1, n2):
                split = f"{min(b, nb)}{lex.bin(one)}{'r' if n > 30 * (min(n1, n2) + 1) else ''}"
        last = t.raw.rstrip()[-1:]
        mark = last in MARKS and len(t.raw) > 1 and (i + 1 == len(toks) or toks[i + 1].line != t.line or text[t.end : t.end + 1].isspace()) and core
        seen = mended is not None
        base = f"{kind}|{place}"
        parted = prev is not None and prev.raw[-1:] in MARKS and len(prev.raw) > 1 and core[:1].islower()
        if mark:
            right = (follow.core if follow else after_text[0].strip(".,;:?!()\"“”") if after_text else "").split("-")[0]
            left = re.split(r"[-\s]", core)[-1]
            jb, lb = lex.bin(left + right) if right else -1, lex.bin(left)
            rb = lex.bin(right) if right else -1
            hb = lex.bin(left.lower() + "-" + right.lower()) if right else -1
            at = t.end - 1
            part = lex.count.get("^" + left.lower(), 0)
            f = [f"m:{last}", f"m:{jb}{lb}{rb}", f"mh:{hb}", f"mj:{jb}", f"ml:{lb}:{rb}", f"m2:{last}:{lb}{rb}", f"mc:{left[:1].isupper()}:{right[:1].isupper()}:{jb > 0}", f"mn:{right == ''}:{lb}:{part > 0}"]
            # Words that stand by themselves and make no word when joined keep their hyphen.
            kept = lex.count.get(left.lower() + "-" + right.lower(), 0) >= lex.count.get((left + right).lower(), 0)
            if seen or last not in "-‐" or jb > 0 and not kept or lb < 2:
                yield at, f + ([f"see:{mended.get(at, 'k')}:m"] if seen else []), ""
        if split:
            yield t.end, [f"sp:{split}", f"sp1:{split[:1]}", "sp"] + ([f"see:{mended.get(t.end, 'k')}:s"] if seen else []), ""
        if furniture or is_num or roman or (t.raw in "-—*·" and (prev and prev.core[:1].isdigit() or follow and follow.core[:1].isdigit())) or kind == "lo+":
            pw = prev.core.lower() if prev else "^"
            nw = follow.core.lower() if follow else "$"
            shape = re.sub(r"[^\W\d_]+", "A", re.sub(r"\d+", "9", t.raw))
            side = f"{prev.raw[-1:] in '-—[*' if prev else ''}{follow.raw[:1] in '-—]*' if follow else ''}"
            # A number within running text: what stands about it tells a page from a count.
            natural = pw in LEAD or bool(prev) and prev.raw[-1:] == "." and prev.line == t.line
            if natural and is_num and not seen and kind[:2] in ("lo", "mi"):
                continue
            nb_, pb_ = lex.bin(nw) if nw.isalpha() else 9, lex.bin(pw) if pw.isalpha() else 9
            run = caps_run.get(t.start, "")
            f = [f"run:{run}", f"runk:{run}:{kind}", f"inrun:{bool(run)}:{is_num}:{kind}", f"after:{prev is not None and prev.start in caps_run}:{prev.raw[-1:] if prev else ''}:{is_num}", f"fk:{base}", f"fk1:{kind}", f"n:{is_num}:{shape}", f"n1:{shape}:{kind}", f"pw:{pw if pb_ > 1 else '?'}:{is_num}", f"nw:{nw if nb_ > 1 else '?'}:{is_num}", f"pwk:{pw if pb_ > 1 else '?'}:{is_num}:{kind[:2]}", f"nat:{natural}:{is_num}:{kind}", f"side:{side}:{is_num}:{shape}", f"t:{run[:1]}:{kind}", f"r:{roman}:{core.islower()}:{kind}", f"pc:{(prev.raw[-1:] if prev else '')}:{is_num}", f"low:{follow.core[:1].islower() if follow else ''}:{is_num}:{kind}"]
            for at in (range(t.start, t.end) if seen else (t.start,)):
                yield at, f + ([f"see:{mended.get(at, 'k')}:f:{is_num}"] if seen else []), None
        elif core and not (parted or mark and not mixed) and (i or not cut_start) and (guess or mixed or (b == 0 and core.isalpha() and i)):
            word = t.raw
            ops = _proposal(word, guess) if guess else {}
            signs = _signs(word, guess) if guess else {}
            cap = core[:1].isupper()
            for k, ch in enumerate(word):
                sym = not ch.isalnum() and 0 < k < len(word) - 1 and ch not in "'’-"
                f = [f"op:{ops.get(k, 'k')}", f"op:{ops.get(k, 'k')}:{sure}:{b}:{cap}", f"ch:{ch if not ch.isalpha() else 'a'}:{mixed}:{k == 0}:{k == len(word) - 1}", f"sym:{sym}:{ch}", f"oov:{b}:{cap}:{bool(guess)}", f"dg:{ch.isdigit()}:{cap}"]
                if not cap:
                    f.append(f"c3:{word[max(0, k - 1) : k + 2]}")
                yield t.start + k, f + ([f"see:{mended.get(t.start + k, 'k')}:w", f"seeop:{mended.get(t.start + k, 'k')}:{ops.get(k, 'k')}"] if seen else []), signs.get(k, "")


def _title_runs(toks: list[Token], head: Heads) -> dict[int, str]:
    """Tokens of a stretch of two or more capitalised words of the work's title or author, by how they are set."""
    out: dict[int, str] = {}
    i = 0
    while i < len(toks):
        k = i
        while k < len(toks) and toks[k].core and (toks[k].core.lower() in head.words or len(toks[k].core) > 4 and toks[k].core[0].isupper() and any(edits(toks[k].core.lower(), w) < 2 for w in head.words if len(w) > 4)):
            k += 1
        if k - i > 2:
            style = "U" if sum(t.core.isupper() for t in toks[i:k]) > (k - i) / 2 else "t"
            opened = "b" if toks[i].raw[0] in "[(" else ""
            # What stands before and behind: a work named in a sentence is set off by its signs.
            before = "/" if i == 0 or toks[i - 1].line != toks[i].line else "." if toks[i - 1].raw[-1:] in ".?!:" else "w"
            last = max(j for j in range(i, len(toks)) if toks[j].line == toks[i].line) if opened else i
            behind = "]" if opened and toks[last].raw[-1] in "])" else "/" if k == len(toks) else toks[k - 1].raw[-1:] if toks[k - 1].raw[-1:] in ",.;:?!" else "/" if toks[k].line != toks[k - 1].line else "w"
            for t in toks[i:k]:
                out[t.start] = style + opened + before + behind
        i = max(k, i + 1)
    return out


def _proposal(word: str, guess: str) -> dict[int, str]:
    ops: dict[int, str] = {}
    for op, i1, i2, j1, j2 in difflib.SequenceMatcher(None, word.lower(), guess, autojunk=False).get_opcodes():
        if op == "replace":
            for k in range(i1, i2):
                ops[k] = "r" if k - i1 < j2 - j1 else "d"
        elif op == "delete":
            for k in range(i1, i2):
                ops[k] = "d" if word[k].isalnum() or 0 < k < len(word) - 1 or word[k] in "~|^*#{•<>" else "k"
        elif op == "insert":
            ops[max(0, i1 - 1)] = "i"
    return ops


def _signs(word: str, guess: str) -> dict[int, str]:
    """The sign that each replaced place of a word gets, or what is put in behind it."""
    out: dict[int, str] = {}
    for op, i1, i2, j1, j2 in difflib.SequenceMatcher(None, word.lower(), guess, autojunk=False).get_opcodes():
        if op == "replace":
            # The last place takes all that is left over.
            for k in range(min(i2 - i1, j2 - j1)):
                out[i1 + k] = guess[j1 + k] if k < i2 - i1 - 1 else guess[j1 + k : j2]
        elif op == "insert":
            out[max(0, i1 - 1)] = guess[j1:j2]
    return out


def gold(find: str, replace: str) -> dict[int, str] | None:
    """Tags of the characters of a correction that mends the print; an editor's change is kept. None: unclear."""
    got = aims(find, replace)
    return None if got is None else got[0]


def aims(find: str, replace: str) -> tuple[dict[int, str], dict[int, str]] | None:
    """The tags of ``gold``, and the signs that replace or are put in."""
    toks = [(m[0], m.start(), m.end()) for m in re.finditer(r"\S+", find)]
    right = replace.split()
    out: dict[int, str] = {}
    signs: dict[int, str] = {}
    for op, i1, i2, j1, j2 in difflib.SequenceMatcher(None, [t[0] for t in toks], right, autojunk=False).get_opcodes():
        part, want = toks[i1:i2], right[j1:j2]
        if op == "equal" or op == "insert":
            continue
        while part and want and len(part) > len(want) and part[0][0] == want[0]:
            part, want = part[1:], want[1:]
        if op == "delete" or not want:
            lettered = any(sum(c.isalpha() for c in t) > 2 and not ROMAN.match(t.strip("[].")) for t, _, _ in part) or sum(len(t) == 1 and t.isalpha() for t, _, _ in part) > 3
            numbered = any(any(c.isdigit() for c in t) or ROMAN.match(t.strip("[].-")) for t, _, _ in part)
            if not lettered and not numbered:
                continue
            if lettered and all(t.islower() for t, _, _ in part):
                continue
            for t, a, b in part:
                tag = "P" if not lettered or re.search(r"\d", t) else "H"
                out.update(dict.fromkeys(range(a, b), tag))
        elif len(part) == len(want):
            for (t, a, _), w in zip(part, want):
                x, y = t.strip(".,;:?!\"“”()").lower(), w.strip(".,;:?!\"“”()").lower()
                if x == y or not any(c.isalpha() for c in y) or custom(x, y) or edits(x, y) > 2:
                    continue
                out.update({a + k: v.upper() for k, v in _proposal(t, w.lower()).items() if v != "k"})
                signs.update({a + k: v for k, v in _signs(t, w.lower()).items()})
        elif len(part) == 2 and len(want) == 1:
            (s, a, b), (u, c, _) = part
            bare = s.rstrip(MARKS)
            if (bare + u).lower() == want[0].lower() or edits((bare + u).lower(), want[0].lower()) < 2:
                out[b - 1 if s != bare else b] = "J" if s != bare else "D"
            else:
                return None
        else:
            return None
    return out, signs


def sight(find: str, replace: str) -> dict[int, str]:
    """For each character of the print whether the mended text lacks it (d) or has another (r) or more after it (i)."""
    out: dict[int, str] = {}
    for op, i1, i2, j1, j2 in difflib.SequenceMatcher(None, find, replace, autojunk=False).get_opcodes():
        if op in ("delete", "replace"):
            for k in range(i1, i2):
                out[k] = "d" if op == "delete" else "r"
        elif op == "insert" and i1:
            out[i1 - 1] = "i"
    return out


#: A place open to question: where, its features, and the sign that the lexicon's reading would put there (None in furniture).
Place = tuple[int, list[str], str | None]
NEVER = -1e9


class Perceptron:
    """Weights by feature and operation, and of an operation behind that of the character before."""

    def __init__(self) -> None:
        self.w: dict[str, list[float]] = {}
        self.signs: dict[str, dict[str, float]] = {}

    def _scores(self, place: Place) -> list[float]:
        """What may be furniture is kept or removed."""
        score = [0.0] * len(TAGS) if place[2] is not None else [0.0 if t in "KHP" else NEVER for t in TAGS]
        for f in place[1]:
            if (w := self.w.get(f)) is not None:
                for k, v in enumerate(w):
                    score[k] += v
        return score

    def decode(self, places: list[Place]) -> list[int]:
        """The best operations: each stretch of adjacent characters as one sequence."""
        out: list[int] = []
        i = 0
        while i < len(places):
            e = i + 1
            while e < len(places) and places[e][0] == places[e - 1][0] + 1:
                e += 1
            now = self._scores(places[i])
            back: list[list[int]] = []
            for k in range(i + 1, e):
                emit, came, step = self._scores(places[k]), [], []
                moves = [self.w.get("prev:" + t) for t in TAGS]
                for y in range(len(TAGS)):
                    best, at = max((now[x] + (moves[x][y] if moves[x] else 0.0), -x) for x in range(len(TAGS)))
                    step.append(best + emit[y])
                    came.append(-at)
                now = step
                back.append(came)
            y = max(range(len(TAGS)), key=lambda k: now[k])
            path = [y]
            for came in reversed(back):
                y = came[y]
                path.append(y)
            out += reversed(path)
            i = e
        return out

    def sign(self, place: Place, ch: str) -> str:
        """The sign for a replaced or filled place; "" where nothing was learned for it."""
        score: dict[str, float] = defaultdict(float)
        for f in _sign_features(place, ch):
            for c, v in self.signs.get(f, {}).items():
                score[c] += v
        pick = max(sorted(score), key=lambda c: score[c]) if score else ""
        return place[2] if pick == "=" else pick

    def train(self, rows: list[tuple[list[Place], list[int]]], epochs: int = EPOCHS, seed: int = 1) -> None:
        total: dict[str, list[float]] = defaultdict(lambda: [0.0] * len(TAGS))
        rng, step, order = random.Random(seed), 0, list(range(len(rows)))

        def move(f: str, want: int, got: int) -> None:
            w, t = self.w.setdefault(f, [0.0] * len(TAGS)), total[f]
            w[want] += 1.0
            w[got] -= 1.0
            t[want] += step
            t[got] -= step

        for _ in range(epochs):
            rng.shuffle(order)
            for r in order:
                places, want = rows[r]
                step += 1
                got = self.decode(places)
                if got == want:
                    continue
                for k, (at, feats, _) in enumerate(places):
                    if got[k] != want[k]:
                        for f in feats:
                            move(f, want[k], got[k])
                    if k and places[k - 1][0] == at - 1 and (got[k - 1], got[k]) != (want[k - 1], want[k]):
                        self.w.setdefault("prev:" + TAGS[want[k - 1]], [0.0] * len(TAGS))[want[k]] += 1.0
                        total["prev:" + TAGS[want[k - 1]]][want[k]] += step
                        self.w.setdefault("prev:" + TAGS[got[k - 1]], [0.0] * len(TAGS))[got[k]] -= 1.0
                        total["prev:" + TAGS[got[k - 1]]][got[k]] -= step
        # The mean of the weights over all steps.
        for f, w in self.w.items():
            t = total[f]
            self.w[f] = [a - b / max(1, step) for a, b in zip(w, t)]

    def train_signs(self, rows: list[tuple[Place, str, str]], epochs: int = EPOCHS, seed: int = 1) -> None:
        """Rows (place, character of the print, sign that is to stand); the class "=" is the lexicon's own sign."""
        total: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
        now: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
        rng, step = random.Random(seed), 0
        rows = list(rows)
        for _ in range(epochs):
            rng.shuffle(rows)
            for place, ch, want in rows:
                step += 1
                want = "=" if want == place[2] else want
                feats = _sign_features(place, ch)
                score: dict[str, float] = defaultdict(float)
                for f in feats:
                    for c, v in now[f].items():
                        score[c] += v
                got = max(sorted(score), key=lambda c: score[c]) if score else ""
                if got != want:
                    for f in feats:
                        for c, v in ((want, 1.0), (got, -1.0)):
                            now[f][c] += v
                            total[f][c] += v * step
        self.signs = {f: {c: v - total[f][c] / max(1, step) for c, v in cs.items() if c} for f, cs in now.items()}


def _sign_features(place: Place, ch: str) -> list[str]:
    c3 = [f for f in place[1] if f.startswith(("c3:", "op:"))]
    return [f"s:{place[2]}", f"c:{ch.lower()}", f"cs:{ch.lower()}:{place[2]}", *c3]


@dataclass
class Editor:
    lex: Lexicon
    model: Perceptron
    works: dict[str, Heads]

    def tags(self, text: str, nxt: str | None, work: str | None, mended: str | None = None, cut_start: bool = False, signs: dict[int, str] | None = None) -> dict[int, str]:
        """Operations other than keep; ``signs`` takes what replaces or is put in."""
        head = self.works.get(work, Heads(frozenset(), ())) if isinstance(work, str) else Heads(frozenset(), ())
        see = sight(text, mended) if isinstance(mended, str) else None
        out = {}
        places = list(features(text, nxt, head, self.lex, see, cut_start))
        for place, k in zip(places, self.model.decode(places)):
            if k and place[0] not in out:
                out[place[0]] = TAGS[k]
                if signs is not None and TAGS[k] in "RI":
                    signs[place[0]] = self.model.sign(place, text[place[0]])
        if see is None:
            # Furniture is judged by its first character and goes as a whole token.
            toks, _ = read_tokens(text)
            for t in toks:
                if out.get(t.start) in ("H", "P"):
                    out.update(dict.fromkeys(range(t.start, t.end), out[t.start]))
        return out

    def noises(self, text: str | None, nxt: str | None, work: str | None, mended: str | None = None, cut_start: bool = False) -> list[str]:
        if not isinstance(text, str) or not text.strip():
            return []
        tags = self.tags(text, nxt, work, mended, cut_start)
        if isinstance(mended, str):
            # An exact check: what the mended text keeps was no noise.
            see = sight(text, mended)
            tags = {k: v for k, v in tags.items() if v in "I" or k in see or (v in "RD" and (k - 1 in see or k + 1 in see))}
        kinds = set(tags.values())
        heads_ = [k for k, v in tags.items() if v == "H" and text[k].isalpha()] if isinstance(text, str) else []
        return [n for n, on in (("hyphen", "J" in kinds), ("misread", bool(kinds & set("RDI"))), ("header", len(heads_) > 3 or bool(heads_) and mended is None), ("page_number", any(v == "P" and (text[k : k + 1].isalnum()) for k, v in tags.items()))) if on]

    def repair(self, text: str | None, work: str | None, nxt: str | None = None) -> str | None:
        """The text as continuous paragraphs: furniture gone, words mended and rejoined, single line breaks closed up."""
        if not isinstance(text, str):
            return None
        text = text.replace("\r\n", "\n").replace("\r", "\n")
        signs: dict[int, str] = {}
        tags = self.tags(text, nxt, work, signs=signs)
        out, i = [], 0
        while i < len(text):
            tag, ch = tags.get(i), text[i]
            sign = signs.get(i, "")
            if tag in ("H", "P"):
                out.append("\0")
            elif tag == "J":
                while i + 1 < len(text) and (text[i + 1].isspace() or tags.get(i + 1) in ("H", "P")):
                    i += 1
            elif tag == "R" and sign:
                out.append(sign.upper() if ch.isupper() else sign)
            elif tag == "I":
                out.append(ch + sign)
            elif tag != "D":
                out.append(ch)
            i += 1
        # Where furniture stood, the text goes on.
        s = re.sub(r"\s*\0[\s\0]*", lambda m: "\n" if "\n" in m[0] else " ", "".join(out))
        parts = re.split(r"\n\s*\n", s)
        return "\n\n".join(p for p in (" ".join(x.split()) for x in parts) if p)


def lexicon(texts: DataFrame) -> tuple[dict[str, int], int]:
    """Counts of lower-cased words over all texts; those of at least one in a million words, so at most a million."""
    words = texts.select(F.explode(F.split(F.lower("text"), r"[^\p{L}\p{M}’'\-]+")).alias("w")).select(F.regexp_replace("w", r"^[’'\-]+|[’'\-]+$", "").alias("w")).where("w <> ''")
    n = cut(words.groupBy("w").agg(F.count(F.lit(1)).alias("n")))
    total = n.agg(F.sum("n")).first()[0] or 0
    rows = bounded(n.where(F.col("n") >= max(2, total // 1_000_000)), MOST_WORDS, "words")
    return {r["w"]: r["n"] for r in rows}, int(total)


def inputs(break_hits: DataFrame, footnote_defs: DataFrame, corrections: DataFrame) -> dict[str, DataFrame]:
    """(rec_id, work_id, text, nxt, mended) of the three sources, each record once."""
    none = F.lit(None).cast("string")
    b = latest(break_hits, "hit_id", "scanned_at", ["work_id", "prev_context", "next_context"])
    f = latest(footnote_defs, "def_id", "scanned_at", ["work_id", "text"])
    c = latest(corrections, "corr_id", "loaded_at", ["work_id", "find", "replace"])
    return {
        "break_hits": b.select(F.col("hit_id").alias("rec_id"), "work_id", F.col("prev_context").alias("text"), F.col("next_context").alias("nxt"), none.alias("mended")),
        "footnote_defs": f.select(F.col("def_id").alias("rec_id"), "work_id", "text", none.alias("nxt"), none.alias("mended")),
        "corrections": c.select(F.col("corr_id").alias("rec_id"), "work_id", F.col("find").alias("text"), none.alias("nxt"), F.col("replace").alias("mended")),
    }


def train(sources: dict[str, DataFrame], documents: DataFrame, works: DataFrame) -> Editor:
    clean = [documents.select("text"), sources["break_hits"].select(F.col("nxt").alias("text")), sources["corrections"].select(F.col("mended").alias("text"))]
    counts, total = lexicon(clean[0].unionByName(clean[1]).unionByName(clean[2]).where("text <> ''"))
    lex = Lexicon(counts, total)
    listed = bounded(works.select("work_id", "author", "title"), 100_000, "works")
    known = {r["work_id"]: heads(r["author"], r["title"]) for r in listed}
    rows: list[tuple[list[Place], list[int]]] = []
    signs: list[tuple[Place, str, str]] = []
    pick = sources["corrections"].where("text <> '' and mended is not null").orderBy(F.xxhash64("rec_id"), "rec_id").limit(SAMPLE)
    for r in sorted(pick.collect(), key=lambda r: r["rec_id"]):
        got = aims(r["text"], r["mended"])
        if got is None:
            continue
        want, put = got
        head = known.get(r["work_id"], Heads(frozenset(), ()))
        for see in (None, sight(r["text"], r["mended"])):
            places = list(features(r["text"], None, head, lex, see))
            rows.append((places, [TAGS.index(want.get(p[0], "K")) for p in places]))
            signs += [(p, r["text"][p[0]], put[p[0]]) for p in places if want.get(p[0]) in ("R", "I") and p[0] in put]
    # Text as it should stand, of which all is kept: mended text, and what follows a break.
    keep = F.xxhash64("rec_id")
    plain = [(r["mended"], r["work_id"]) for r in sorted(sources["corrections"].where("mended <> ''").orderBy(keep, "rec_id").limit(SAMPLE).collect(), key=lambda r: r["rec_id"])]
    # The same set in printed lines: a number may begin or fill a line.
    plain += [(textwrap.fill(text, 24 + zlib.crc32(text.encode("utf-8", "surrogatepass")) % 32), work) for text, work in plain]
    # Works named within a sentence are no running heads: the title set into mended text, before a comma, with a place or without.
    titles = {r["work_id"]: r["title"] for r in listed if r["title"]}
    for k, (text, work) in enumerate(list(plain)):
        if work in titles:
            words = text.split(" ")
            at = zlib.crc32(text.encode("utf-8", "surrogatepass")) % len(words)
            named = f"{titles[work]}, {1 + k % 12}.{1 + k % 40}" + (". " if k % 3 else ", ") if k % 2 else titles[work] + ", "
            plain.append((" ".join(words[: at + 1]) + " " + named + " ".join(words[at + 1 :]), work))
    plain += [(r["nxt"], r["work_id"]) for r in sorted(sources["break_hits"].where("nxt <> ''").orderBy(keep, "rec_id").limit(SAMPLE).collect(), key=lambda r: r["rec_id"])]
    for text, work in plain:
        places = [p for p in features(text, None, known.get(work, Heads(frozenset(), ())), lex, None, True) if p[0] < len(text) - 12]
        rows.append((places, [0] * len(places)))
    model = Perceptron()
    model.train(rows)
    model.train_signs(signs)
    return Editor(lex, model, known)


_EDITORS: dict[int, Editor] = {}


def _apply(rows: DataFrame, editor: Editor, one, schema: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((editor.lex.count, editor.lex.total, editor.model.w, editor.model.signs, editor.works))
    number = shared._jbroadcast.id()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A worker builds the lexicon's index once, for all its tasks.
        if number not in _EDITORS:
            count, total, weights, signs, works = shared.value
            model = Perceptron()
            model.w, model.signs = weights, signs
            _EDITORS.clear()
            _EDITORS[number] = Editor(Lexicon(count, total), model, works)
        e = _EDITORS[number]
        for b in batches:
            yield pd.DataFrame([(r.src, r.rec_id, x) for r in b.itertuples() for x in one(e, r)], columns=["src", "rec_id", "x"])

    return spread(rows).mapInPandas(run, schema)


def _all(sources: dict[str, DataFrame]) -> DataFrame:
    from functools import reduce

    return reduce(DataFrame.unionByName, [df.select(F.lit(src).alias("src"), "*") for src, df in sources.items()])


def found(sources: dict[str, DataFrame], editor: Editor) -> DataFrame:
    """(src, rec_id, noise). Null, empty and blank texts hold no noise."""
    return _apply(_all(sources), editor, lambda e, r: e.noises(r.text, r.nxt, r.work_id, r.mended, r.src == "break_hits"), "src string, rec_id long, x string").withColumnRenamed("x", "noise")


def repaired(sources: dict[str, DataFrame], editor: Editor) -> DataFrame:
    """(src, rec_id, repaired): null stays null."""
    return _apply(_all(sources), editor, lambda e, r: [e.repair(r.text, r.work_id, r.nxt)], "src string, rec_id long, x string").withColumnRenamed("x", "repaired")
