"""Alignment of ordered streams within bounded groups (a chapter, a dialogue), by Arrow-batched grouped functions."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _vectors(texts: list[str]) -> np.ndarray:
    bags = [Counter(re.findall(r"\w+", t.lower())) for t in texts]
    vocab = {w: i for i, w in enumerate(sorted(set().union(*bags)))} if bags else {}
    df = Counter(w for b in bags for w in b)
    m = np.zeros((len(texts), len(vocab) or 1))
    for r, b in enumerate(bags):
        size = sum(b.values()) or 1
        for w, c in b.items():
            m[r, vocab[w]] = c / size * (math.log((len(texts) + 1) / (df[w] + 1)) + 1)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1, norm)


def similarity(a: list[str], b: list[str]) -> np.ndarray:
    v = _vectors([*a, *b])
    return v[: len(a)] @ v[len(a) :].T


def monotone(s: np.ndarray) -> list[int]:
    """For each row a column, never falling, of greatest total similarity; of equal ones the earliest.

    A row's best totals need, of the row before, only its running maximum and where that was first reached.
    """
    if not s.size:
        return []
    columns = np.arange(s.shape[1])
    total, origins = s[0], []
    for row in s[1:]:
        peak = np.maximum.accumulate(total)
        fresh = np.concatenate([[True], peak[1:] > peak[:-1]])
        origins.append(np.maximum.accumulate(np.where(fresh, columns, 0)))
        total = row + peak
    path = [int(total.argmax())]
    for origin in reversed(origins):
        path.append(int(origin[path[-1]]))
    return path[::-1]


def lcs(a: list, b: list) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence; an element of ``a`` is passed over wherever that costs nothing.

    Lengths left over are filled a row at a time: a row is the running maximum, from the
    right, of the row below and of that row one on where elements match. Pairs are then
    read off by leaps to the next row that matches here or is needed.
    """
    number: dict = {}
    u, v = (np.array([number.setdefault(x, len(number)) for x in xs], dtype=np.int64) for xs in (a, b))
    left = np.zeros((len(u) + 1, len(v) + 1), dtype=np.int32)
    for i in range(len(u) - 1, -1, -1):
        step = np.where(v == u[i], left[i + 1, 1:] + 1, left[i + 1, :-1])
        left[i, :-1] = np.maximum.accumulate(step[::-1])[::-1]
    pairs, i, j = [], 0, 0
    while i < len(u) and j < len(v) and left[i, j]:
        needed = (left[i:-1, j] > left[i + 1 :, j]) | (u[i:] == v[j])
        i += int(needed.argmax())
        j += int((v[j:] == u[i]).argmax())
        pairs.append((i, j))
        i, j = i + 1, j + 1
    return pairs


def global_pairs(s: np.ndarray, allowed: np.ndarray, gap: float = -0.1) -> list[tuple[int, int]]:
    """Needleman-Wunsch: pairs where allowed, each gap at a cost; the diagonal is preferred, then the first stream."""
    n, m = s.shape
    t = np.zeros((n + 1, m + 1))
    t[1:, 0] = gap * np.arange(1, n + 1)
    t[0, 1:] = gap * np.arange(1, m + 1)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            t[i, j] = max(t[i - 1, j - 1] + s[i - 1, j - 1] if allowed[i - 1, j - 1] else -math.inf, t[i - 1, j] + gap, t[i, j - 1] + gap)
    out, i, j = [], n, m
    while i and j:
        if allowed[i - 1, j - 1] and math.isclose(t[i, j], t[i - 1, j - 1] + s[i - 1, j - 1]):
            out.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif math.isclose(t[i, j], t[i - 1, j] + gap):
            i -= 1
        else:
            j -= 1
    return out[::-1]


def beads(a: list[str], b: list[str]) -> list[tuple[int, int, int, int]]:
    """(i, n, j, m): beads 1-1, 1-2, 2-1, 2-2, 1-0, 0-1 of greatest similarity less a penalty for unlike length."""
    n, m = len(a), len(b)
    kinds = [(1, 1), (1, 2), (2, 1), (2, 2), (1, 0), (0, 1)]
    ratio = sum(map(len, b)) / max(1, sum(map(len, a)))
    v = _vectors([*a, *b])
    best, back = np.full((n + 1, m + 1), -math.inf), {}
    best[0, 0] = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            for p, q in kinds:
                if i < p or j < q or best[i - p, j - q] == -math.inf:
                    continue
                if p and q:
                    x, y = v[i - p : i].sum(axis=0), v[n + j - q : n + j].sum(axis=0)
                    sim = float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y) or 1))
                    la, lb = sum(map(len, a[i - p : i])) * ratio + 1, sum(map(len, b[j - q : j])) + 1
                    sc = sim * (p + q) / 2 - 0.3 * abs(math.log(lb / la)) - 0.05 * (p + q - 2)
                else:
                    sc = -0.25
                if best[i - p, j - q] + sc > best[i, j]:
                    best[i, j] = best[i - p, j - q] + sc
                    back[i, j] = (p, q)
    out, i, j = [], n, m
    while i or j:
        p, q = back[i, j]
        out.append((i - p, p, j - q, q))
        i, j = i - p, j - q
    return out[::-1]


def fill_gaps(a: list, b: list, anchors: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Anchors with what lies between them: stretches of equal length are paired in order, and of others equal labels as far as they keep the order."""
    out: list[tuple[int, int]] = []
    i = j = 0
    for p, q in [*anchors, (len(a), len(b))]:
        if p - i == q - j:
            out += zip(range(i, p), range(j, q))
        else:
            out += [(i + x, j + y) for x, y in lcs(a[i:p], b[j:q])]
        if p < len(a):
            out.append((p, q))
        i, j = p + 1, q + 1
    return out


def zip_gaps(a: list, b: list, pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Pairs with those left over of each label between two of them, the first with the first, where the order allows it."""
    out: list[tuple[int, int]] = []
    for (p, q), (r, s) in zip([(-1, -1), *pairs], [*pairs, (len(a), len(b))]):
        floor = q
        for i in range(p + 1, r):
            j = next((j for j in range(floor + 1, s) if a[i] is not None and b[j] == a[i]), None)
            if j is not None:
                out.append((i, j))
                floor = j
        if r < len(a):
            out.append((r, s))
    return out


def margins(s: np.ndarray, path: list[int]) -> list[float]:
    """For each row how far its column's similarity lies above that of the best other column; 1 where there is no other."""
    out = []
    for row, j in zip(s, path):
        rest = np.delete(row, j)
        out.append(float(row[j] - rest.max()) if len(rest) else 1.0)
    return out


def align_groups(left: DataFrame, right: DataFrame, by: str, how: str) -> DataFrame:
    """(by, a, b) of streams (by, ord, label, text): pairs of ord within each group by one of the methods above.

    Null labels pair with any; null texts count as empty; a group on one side gives no pair.
    """

    def run(key: tuple, l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        l, r = l.sort_values("ord"), r.sort_values("ord")
        ta, tb = l["text"].fillna("").tolist(), r["text"].fillna("").tolist()
        if not ta or not tb:
            return pd.DataFrame({"g": [], "a": [], "b": []})
        la, lb = l["label"].tolist(), r["label"].tolist()
        if how == "lcs":
            pairs = lcs(la, lb)
        elif how == "filled":
            pairs = fill_gaps(la, lb, lcs(la, lb))
        elif how == "monotone":
            pairs = list(enumerate(monotone(similarity(ta, tb))))
        elif how == "beads":
            pairs = [(i + x, j + y) for i, p, j, q in beads(ta, tb) for x in range(p) for y in range(q)]
        else:
            ok = np.array([[x == y or x is None or y is None for y in lb] for x in la])
            pairs = global_pairs(similarity(ta, tb), ok)
            pairs = zip_gaps(la, lb, pairs) if how == "zipped" else pairs
        oa, ob = l["ord"].tolist(), r["ord"].tolist()
        return pd.DataFrame([(key[0], oa[i], ob[j]) for i, j in pairs], columns=["g", "a", "b"])

    cols = [by, "ord", "label", "text"]
    return left.select(*cols).groupBy(by).cogroup(right.select(*cols).groupBy(by)).applyInPandas(run, "g long, a long, b long").withColumnRenamed("g", by)


def hunks(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, at, removed, added): runs of words outside a longest common subsequence, each row by itself."""

    def run(batches):
        for x in batches:
            out = []
            for k, s, t in zip(x["k"], x["a"], x["b"]):
                u, v = s.split(), t.split()
                i = j = 0
                for p, q in [*lcs(u, v), (len(u), len(v))]:
                    if p > i or q > j:
                        out.append((k, i, " ".join(u[i:p]), " ".join(v[j:q])))
                    i, j = p + 1, q + 1
            yield pd.DataFrame(out, columns=["k", "at", "removed", "added"])

    rows = df.select(F.col(key).alias("k"), F.col(a).alias("a"), F.col(b).alias("b")).where("k is not null and a is not null and b is not null")
    return rows.mapInPandas(run, "k long, at long, removed string, added string").withColumnRenamed("k", key)


def pages(df: DataFrame, by: str, order: str, size: str, target: int) -> DataFrame:
    """(by, order, page): whole blocks packed in order up to ``target``; a larger block has a page of its own."""

    def run(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        page, full, out = 1, 0, []
        for o, n in b.sort_values(order)[[order, size]].itertuples(index=False):
            if full and full + n > target:
                page, full = page + 1, 0
            full += n
            out.append((key[0], o, page))
        return pd.DataFrame(out, columns=["g", "o", "page"])

    kind = df.schema[by].dataType.simpleString()
    out = df.select(by, order, size).groupBy(by).applyInPandas(run, f"g {kind}, o long, page long")
    return out.select(F.col("g").alias(by), F.col("o").alias(order), "page")

