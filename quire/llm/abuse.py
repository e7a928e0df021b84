"""Abusive, hateful and sexual passages by a linear-chain conditional random field.

Readers mark whole documents, and err. Token labels for training are found in two steps:
log-likelihood ratios of word sequences in marked against clean documents point to the
sentences that carry a mark, and the field trained on these labels relabels the
sentences of its own sample (a marked document in which nothing stands out stays clean).
The field is fitted in tasks over shards of the sample, whose weights are mixed after
each pass. Forward-backward marginals of the tokens are aggregated to scores and offsets.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TooLarge, bounded, cut, spread
from .lookalike import LOOKALIKES

CATEGORIES = ("abuse", "hate", "sexual")
TAGS = ("none", *CATEGORIES)
#: Bounds of the training sample: documents with a mark of a category, and documents marked "none".
MARKED, CLEAN = 3000, 6000
#: Documents of the sample in each shard that a task fits: with fewer, the mixed weights need many more passes.
SHARD = 2000
BITS, WINDOW = 18, 6
#: Passes over the sample with the first labels, and with the field's own.
EPOCHS = (5, 8)
#: Documents whose tokens a task holds at once.
AT_ONCE = 400
SIGNIFICANT, SHARE = 1.5, 0.5
#: Up to so many word sequences are sent to every task to count them alone; beyond, all are counted and joined.
MOST_SEQUENCES = 500_000
THRESHOLD = 0.5

_CYRILLIC = str.maketrans({k: v for k, v in LOOKALIKES.items() if "Ѐ" <= k < "Ԁ"})
_SENTENCE = re.compile(r"(?<=[.!?;。！？…])[\"”»“’)]*\s+|[\r\n]+")
_TOKEN = re.compile(r"[\w­​-‍⁠﻿*@$]+(?:['’][\w]+)*|[^\w\s]")
# Signs written for letters.
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})


@lru_cache(300_000)
def normal(word: str) -> str:
    """A word's form with invisible signs, width, look-alikes, signs for letters and stretched letters undone."""
    if word.isascii() and word.isalpha():
        w = word.lower()
    else:
        w = "".join(ch for ch in unicodedata.normalize("NFKC", word) if unicodedata.category(ch) != "Cf").lower()
        if any("Ѐ" <= ch < "Ԁ" for ch in w):
            w = w.translate(_CYRILLIC)
        if any(ch.isalpha() for ch in w) and not w.isalpha():
            w = w.translate(_LEET)
    return re.sub(r"(.)\1{2,}", r"\1", w)


def skeleton(w: str) -> str:
    return re.sub(r"[^bcdfghjklmnpqrstvwxzßçþа-яα-ωά-ώ]", "", w)


def sentences(text: str) -> Iterator[tuple[int, list[tuple[str, int, int]]]]:
    """(start, tokens with offsets) of each sentence."""
    at = 0
    for m in [*_SENTENCE.finditer(text), None]:
        end = m.start() if m else len(text)
        if end > at:
            yield at, [(t[0], t.start(), t.end()) for t in _TOKEN.finditer(text, at, end)]
        at = m.end() if m else end


def _hash(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass"))


def _mixed(a: np.ndarray, b: np.ndarray | int, kind: int) -> np.ndarray:
    """Bins of pairs of hashes, apart for each kind of feature."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + np.asarray(b, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(kind * 0x165667B19E3779F9 % (1 << 64))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(64 - BITS)).astype(np.int32)


class Featurizer:
    """Bins of the features of each token: its forms and shape, and the words and pairs of words about it."""

    def __init__(self) -> None:
        self.words: dict[str, tuple] = {}

    def word(self, raw: str) -> tuple:
        got = self.words.get(raw)
        if got is None:
            w = normal(raw)
            k = skeleton(w)
            shape = "U" if len(raw) > 2 and raw.isupper() else "C" if raw[:1].isupper() else "d" if raw.isdigit() else "l" if raw[:1].isalpha() else "p"
            got = tuple(map(_hash, (w, k if len(k) > 2 else w, w[:4], w[-4:], shape)))
            if len(self.words) > 300_000:
                self.words.clear()
            self.words[raw] = got
        return got

    def rows(self, sents: list[list[tuple[str, int, int]]]) -> list[np.ndarray]:
        """(tokens, WIDTH) of each sentence."""
        if not sents:
            return []
        lengths = np.array([len(t) for t in sents])
        own = np.array([self.word(t[0]) for toks in sents for t in toks], dtype=np.uint64).reshape(-1, 5)
        n = len(own)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        left = np.arange(n) - np.repeat(starts, lengths)
        right = np.repeat(lengths, lengths) - 1 - left
        w = own[:, 0]

        def at(k: int) -> np.ndarray:
            """The word k places on; beyond the sentence 1 before it and 2 behind it."""
            inside = (left >= -k) if k < 0 else (right >= k)
            return np.where(inside, np.roll(w, -k), np.uint64(1 if k < 0 else 2))

        a, aa, b, bb = at(-1), at(-2), at(1), at(2)
        out = np.stack(
            [*(_mixed(own[:, c], 0, c) for c in range(5)), _mixed(a, 0, 5), _mixed(b, 0, 6), _mixed(aa, 0, 7), _mixed(bb, 0, 8), _mixed(a, w, 9), _mixed(w, b, 10), _mixed(aa, a, 11), _mixed(b, bb, 12)], axis=1
        )
        return np.split(out, np.cumsum(lengths)[:-1])


WIDTH = 13


@dataclass
class Field:
    """Weights of features by tag, and of tag transitions."""

    emit: np.ndarray
    move: np.ndarray

    def marginals(self, feats: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a padded batch (B, T, WIDTH): tag marginals, expected transitions, and log-partition."""
        b, t = mask.shape
        u = self.emit[feats].sum(axis=2)
        k = u.shape[2]
        alpha, beta = np.empty((b, t, k)), np.zeros((b, t, k))
        alpha[:, 0] = u[:, 0]
        for i in range(1, t):
            m = alpha[:, i - 1].max(axis=1, keepdims=True)
            step = np.log(np.exp(alpha[:, i - 1] - m) @ np.exp(self.move)) + m + u[:, i]
            alpha[:, i] = np.where(mask[:, i, None], step, alpha[:, i - 1])
        for i in range(t - 2, -1, -1):
            v = u[:, i + 1] + beta[:, i + 1]
            m = v.max(axis=1, keepdims=True)
            step = np.log(np.exp(v - m) @ np.exp(self.move).T) + m
            beta[:, i] = np.where(mask[:, i + 1, None], step, 0.0)
        top = alpha[:, -1].max(axis=1, keepdims=True)
        logz = top[:, 0] + np.log(np.exp(alpha[:, -1] - top).sum(axis=1))
        tags = np.exp(alpha + beta - logz[:, None, None]) * mask[:, :, None]
        pair = np.zeros((k, k))
        for i in range(1, t):
            on = mask[:, i]
            if on.any():
                x = alpha[on, i - 1][:, :, None] + self.move[None] + (u[on, i] + beta[on, i])[:, None, :] - logz[on, None, None]
                pair += np.exp(x).sum(axis=0)
        return tags, pair, logz


def _batches(lengths: np.ndarray, tokens: int = 24_000) -> Iterator[np.ndarray]:
    order = np.argsort(lengths, kind="stable")
    k = 0
    while k < len(order):
        e = k
        while e < len(order) and (e - k + 1) * lengths[order[e]] <= tokens or e == k:
            e += 1
        yield order[k:e]
        k = e


def _pad(items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = max(len(x) for x in items)
    feats = np.zeros((len(items), n, WIDTH), dtype=np.int32)
    mask = np.zeros((len(items), n), dtype=bool)
    for i, x in enumerate(items):
        feats[i, : len(x)] = x
        mask[i, : len(x)] = True
    return feats, mask


def epoch(model: Field, past: Field, feats: list[np.ndarray], tags: list[np.ndarray], weight: np.ndarray, seed: int) -> None:
    """One pass of AdaGrad (``past`` holds its sums of squares) over batches of sentences of like length."""
    k = len(TAGS)
    groups = list(_batches(np.array([len(x) for x in feats]), 12_000))
    for g in np.random.default_rng(seed).permutation(len(groups)):
        rows = groups[g]
        f, mask = _pad([feats[i] for i in rows])
        gold, seen = np.zeros((*mask.shape, k), dtype=np.float32), np.zeros((k, k))
        for r, i in enumerate(rows):
            gold[r, np.arange(len(tags[i])), tags[i]] = 1.0
            np.add.at(seen, (tags[i][:-1], tags[i][1:]), 1.0)
        hit, at = np.unique(f[mask], return_inverse=True)
        at = at.ravel()
        marg, pair, _ = model.marginals(f, mask)
        diff = ((gold - marg) * weight[rows][:, None, None])[mask]
        grad = np.stack([np.bincount(at, np.repeat(diff[:, c], WIDTH), minlength=len(hit)) for c in range(k)], axis=1)
        part = grad - 1e-3 * model.emit[hit]
        part[hit == 0] = 0.0
        past.emit[hit] += part * part
        model.emit[hit] += 0.25 * part / np.sqrt(past.emit[hit])
        part = seen - pair
        past.move += part * part
        model.move += 0.1 * part / np.sqrt(past.move)


def fit(rows: DataFrame, epochs: int, seed: int = 1) -> Field:
    """Maximum likelihood over rows (feats binary, tag int, weight double), each partition a shard.

    Each pass starts from the mixed weights of all shards: a feature's change is the mean
    over the shards that hold it. Features that the sample holds once are left out.
    """
    k, size = len(TAGS), 1 << BITS
    spark = rows.sparkSession

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(size, dtype=np.int32)
        for b in batches:
            for x in b["feats"]:
                n += np.bincount(np.frombuffer(x, dtype=np.int32), minlength=size).astype(np.int32)
        yield pd.DataFrame({"n": [n.tobytes()]})

    counts = np.zeros(size, dtype=np.int64)
    for r in rows.select("feats").mapInPandas(counted, "n binary").collect():
        counts += np.frombuffer(r["n"], dtype=np.int32)
    ids = np.flatnonzero(counts > 1)
    dense = np.zeros(size, dtype=np.int32)
    dense[ids] = np.arange(1, len(ids) + 1)
    numbers = spark.sparkContext.broadcast(dense)
    model, past = (Field(np.full((len(ids) + 1, k), v, dtype=np.float32), np.full((k, k), v, dtype=np.float32)) for v in (0.0, 1e-6))
    for turn in range(epochs):
        shared = spark.sparkContext.broadcast((model, past))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            feats, tags, weight = [], [], []
            for b in batches:
                for x, t, w in zip(b["feats"], b["tag"], b["weight"]):
                    feats.append(numbers.value[np.frombuffer(x, dtype=np.int32)].reshape(-1, WIDTH))
                    tags.append(np.full(len(feats[-1]), t, dtype=np.int8))
                    weight.append(w)
            if not feats:
                return
            was, sums = shared.value
            new, after = Field(was.emit.copy(), was.move.copy()), Field(sums.emit.copy(), sums.move.copy())
            epoch(new, after, feats, tags, np.array(weight), seed + turn)
            hit = np.unique(np.concatenate([x.ravel() for x in feats]))
            blobs = (hit.astype(np.int32), (new.emit - was.emit)[hit].astype(np.float32), (after.emit - sums.emit)[hit].astype(np.float32), (new.move - was.move).astype(np.float32), (after.move - sums.move).astype(np.float32))
            yield pd.DataFrame([[x.tobytes() for x in blobs]], columns=["hit", "emit", "emit2", "move", "move2"])

        def mix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n, n_all = np.zeros((len(ids) + 1, 1), dtype=np.float32), 0
            emit, emit2, move, move2 = (np.zeros(x, dtype=np.float32) for x in ((len(n), k), (len(n), k), (k, k), (k, k)))
            for b in batches:
                for hit, e, e2, v, v2 in zip(*(b[c] for c in ("hit", "emit", "emit2", "move", "move2"))):
                    hit = np.frombuffer(hit, dtype=np.int32)
                    n[hit] += 1
                    n_all += 1
                    emit[hit] += np.frombuffer(e, dtype=np.float32).reshape(-1, k)
                    emit2[hit] += np.frombuffer(e2, dtype=np.float32).reshape(-1, k)
                    move += np.frombuffer(v, dtype=np.float32).reshape(k, k)
                    move2 += np.frombuffer(v2, dtype=np.float32).reshape(k, k)
            if n_all:
                yield pd.DataFrame([[x.tobytes() for x in (emit / np.maximum(n, 1), emit2 / np.maximum(n, 1), move / np.float32(n_all), move2 / np.float32(n_all))]], columns=["emit", "emit2", "move", "move2"])

        # One row comes back for each pass: the shards are few, as the sample is bounded.
        got = rows.mapInPandas(run, "hit binary, emit binary, emit2 binary, move binary, move2 binary").repartition(1).mapInPandas(mix, "emit binary, emit2 binary, move binary, move2 binary").collect()
        shared.destroy()
        if not got:
            break
        emit, emit2, move, move2 = (np.frombuffer(got[0][c], dtype=np.float32).reshape(-1, k) for c in ("emit", "emit2", "move", "move2"))
        model, past = Field(model.emit + emit, model.move + move), Field(past.emit + emit2, past.move + move2)
    full = np.zeros((size, k), dtype=np.float32)
    full[ids] = model.emit[1:]
    return Field(full, model.move)


def passage(marg: np.ndarray) -> np.ndarray:
    """Of a sentence's marginals: for each category the largest mean over WINDOW tokens in a row, or over all of fewer."""
    n = min(WINDOW, len(marg))
    c = np.cumsum(np.vstack([np.zeros((1, marg.shape[1])), marg]), axis=0)
    return ((c[n:] - c[:-n]) / n).max(axis=0)[1:]


def predict(model: Field, feats: list[np.ndarray]) -> list[np.ndarray]:
    out: list[np.ndarray] = [np.zeros((0, len(TAGS)))] * len(feats)
    for rows in _batches(np.array([len(x) for x in feats])):
        f, mask = _pad([feats[i] for i in rows])
        marg, _, _ = model.marginals(f, mask)
        for r, i in enumerate(rows):
            out[i] = marg[r, : len(feats[i])]
    return out


def few_at_once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for k in range(0, len(b), AT_ONCE):
            yield b.iloc[k : k + AT_ONCE].reset_index(drop=True)


def grams(toks: list[tuple[str, int, int]]) -> set[str]:
    """Word sequences of up to three of a sentence, with names and numbers masked."""
    ws = []
    for i, (raw, _, _) in enumerate(toks):
        w = normal(raw)
        ws.append("#" if raw[:1].isdigit() else "N" if i and raw[:1].isupper() and not raw.isupper() else w)
    out = {w for w in ws if len(w) > 1 and w != "N"}
    out |= {f"{a} {b}" for a, b in zip(ws, ws[1:])}
    return out | {f"{a} {b} {c}" for a, b, c in zip(ws, ws[1:], ws[2:])}


def votes(labels: DataFrame) -> DataFrame:
    """(doc_id, category, n readers): one mark counts once for a document, reader and category; null categories are no mark."""
    one = labels.select("doc_id", "annotator", "category").where("doc_id is not null and category in ('abuse', 'hate', 'sexual', 'none')").distinct()
    return one.groupBy("doc_id").agg(*[F.count(F.when(F.col("category") == c, 1)).alias(c) for c in TAGS])


SAMPLE = "doc_id long, no int, marked boolean, abuse double, hate double, sexual double, feats binary, grams array<string>"


def sample(documents: DataFrame, labels: DataFrame) -> tuple[DataFrame, int]:
    """(sentences, number of shards) of up to MARKED marked and CLEAN clean documents, chosen by a hash of the id, with the shares of their marks."""
    v = votes(labels)
    pick = F.xxhash64("doc_id")
    marked = v.where("abuse + hate + sexual > 0").orderBy(pick, "doc_id").limit(MARKED)
    clean = v.where("abuse + hate + sexual = 0").orderBy(pick, "doc_id").limit(CLEAN)
    picked = cut(marked.unionByName(clean))
    shards = -(-max(1, picked.count()) // SHARD)
    docs = documents.select("doc_id", "text").where("text <> ''").join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = Featurizer()
        for b in few_at_once(batches):
            out = []
            for d, text, *n in zip(b["doc_id"], b["text"], *(b[c] for c in (*CATEGORIES, "none"))):
                toks = [t for _, t in sentences(text) if t]
                on = sum(n[:3]) > 0
                share = [x / max(1, sum(n)) for x in n[:3]]
                out += [(d, k, on, *share, x.tobytes(), sorted(grams(t)) if on else []) for k, (t, x) in enumerate(zip(toks, f.rows(toks)))]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SAMPLE.split(", ")])

    return docs.mapInPandas(run, SAMPLE), shards


def occurrences(documents: DataFrame, labels: DataFrame, wanted: DataFrame) -> tuple[float, float, DataFrame]:
    """Over all labelled documents: marked and clean ones, and (g, m, c) how many of each hold each wanted word sequence.

    A document counts as marked by the share of its readers who marked it.
    """
    try:
        shared = documents.sparkSession.sparkContext.broadcast({r["g"] for r in bounded(wanted.select("g"), MOST_SEQUENCES, "word sequences")})
    except TooLarge:
        shared = None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n: dict[str, float] = defaultdict(float)
            m: dict[str, float] = defaultdict(float)
            for t, share in zip(b["text"], b["share"]):
                for g in {""}.union(*[grams(toks) & shared.value if shared is not None else grams(toks) for _, toks in sentences(t)]):
                    n[g] += 1.0
                    m[g] += share
            yield pd.DataFrame([(g, m[g], n[g] - m[g]) for g in n], columns=["g", "m", "c"])

    v = votes(labels).select("doc_id", ((F.col("abuse") + F.col("hate") + F.col("sexual")) / (F.col("abuse") + F.col("hate") + F.col("sexual") + F.col("none"))).alias("share"))
    rows = spread(documents.where("text <> ''").select("doc_id", "text")).join(v, "doc_id").select("text", "share")
    sums = cut(rows.mapInPandas(run, "g string, m double, c double").groupBy("g").agg(F.sum("m").alias("m"), F.sum("c").alias("c")))
    all_ = sums.where("g = ''").first()
    return (all_["m"], all_["c"], sums) if all_ else (0.0, 0.0, sums)


def _llr(k1, n1: float, k2, n2: float):
    """Log-likelihood ratio of a higher first rate, as a column; 0 where it is not higher."""

    def ll(k, n, p):
        return F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(n - k > 0, (n - k) * F.log(1 - p)).otherwise(0.0)

    n1, n2 = F.lit(float(n1)), F.lit(float(n2))
    p = (k1 + k2) / (n1 + n2)
    ratio = 2 * (ll(k1, n1, k1 / n1) + ll(k2, n2, k2 / n2) - ll(k1, n1, p) - ll(k2, n2, p))
    return F.when((n1 <= 0) | (n2 <= 0) | (k1 + k2 <= 0) | (k1 + k2 >= n1 + n2) | (k1 / n1 <= k2 / n2), 0.0).otherwise(ratio)


def _weight(tag):
    """Sentences of clean documents are sure; those of marked ones may be wrongly left."""
    return F.when(F.col("marked") & (tag == 0), 0.6).otherwise(1.0)


def train(documents: DataFrame, labels: DataFrame) -> Field | None:
    """The field, or None where no document is marked."""
    seqs, shards = sample(documents, labels)
    seqs = cut(seqs)
    held = seqs.where("marked").select("doc_id", "no", *CATEGORIES, F.explode("grams").alias("g"))
    wanted = cut(
        held.select("doc_id", *CATEGORIES, "g").distinct().groupBy("g").agg(F.count(F.lit(1)).alias("docs"), *[F.sum(c).alias(f"by_{c}") for c in CATEGORIES]).where("docs > 1")
    )
    n = wanted.count()
    if not n and not seqs.where("marked").limit(1).count():
        return None
    marked, clean, counts = occurrences(documents, labels, wanted)
    value = wanted.join(counts, "g").where(F.col("m") >= SHARE * (F.col("m") + F.col("c"))).withColumn("s", _llr(F.col("m"), marked, F.col("c"), clean)).where("s > 0")
    # Of each sentence the three strongest sequences: they tell whether it is marked, and as what.
    top = held.join(value.select("g", "s", *[f"by_{c}" for c in CATEGORIES]), "g").groupBy("doc_id", "no").agg(
        F.slice(F.sort_array(F.collect_list(F.struct("s", "g", *[f"by_{c}" for c in CATEGORIES])), asc=False), 1, 3).alias("best"), *[F.first(c).alias(c) for c in CATEGORIES]
    )

    def total(name: str):
        return F.aggregate("best", F.lit(0.0), lambda acc, x: acc + x[name])

    by = F.array(*[F.struct((total(f"by_{c}") * (1.0 + F.col(c))).alias("v"), F.lit(c).alias("c"), F.lit(k + 1).alias("k")) for k, c in enumerate(CATEGORIES)])
    strong = total("s") / 3 >= SIGNIFICANT * float(np.log(n + 1))
    top = top.select("doc_id", "no", F.array_max(by)["k"].alias("kind"), strong.alias("strong"))
    rows = seqs.select("doc_id", "no", "marked", "feats").join(top, ["doc_id", "no"], "left")
    rows = rows.select("doc_id", "marked", "feats", F.coalesce("kind", F.lit(0)).alias("kind"), F.when(F.col("strong"), F.col("kind")).otherwise(0).alias("tag"))
    rows = cut(rows.withColumn("weight", _weight(F.col("tag"))).repartition(shards, "doc_id"))
    model = fit(rows.select("feats", "tag", "weight"), EPOCHS[0])
    for epochs in EPOCHS[1:]:
        shared = documents.sparkSession.sparkContext.broadcast(model)

        def relabel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                marg = predict(shared.value, [np.frombuffer(x, dtype=np.int32).reshape(-1, WIDTH) for x in b["feats"]])
                tags = []
                for m, on, kind in zip(marg, b["marked"], b["kind"]):
                    p = m.mean(axis=0)
                    # Readers' marks of the same words, summed over documents, tell the category best.
                    tags.append((kind or int(p[1:].argmax()) + 1) if on and p[1:].sum() > 0.5 else 0)
                yield b.assign(tag=np.array(tags, dtype=np.int32))[["doc_id", "marked", "feats", "kind", "tag"]]

        rows = rows.select("doc_id", "marked", "feats", "kind").mapInPandas(relabel, "doc_id long, marked boolean, feats binary, kind int, tag int")
        rows = cut(rows.withColumn("weight", _weight(F.col("tag"))))
        model = fit(rows.select("feats", "tag", "weight"), epochs)
    return Field(model.emit.astype(np.float32), model.move.astype(np.float32))


SCORES = "doc_id long, source string, abuse double, hate double, sexual double, spans array<struct<category:string,start:int,end:int,p:double>>"


def score(documents: DataFrame, model: Field | None) -> DataFrame:
    """(doc_id, source, abuse, hate, sexual, spans) for every document.

    A score is the largest mean marginal of a passage of a few words; ``spans`` are the code-point
    offsets of runs of tokens of one category. Null, empty and blank texts score 0, as do
    all documents where nothing was marked to learn from. Repeated ids stay repeated.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        field, f = shared.value, Featurizer()
        for b in few_at_once(batches):
            held: list[tuple[int, list, int]] = []
            known: dict[tuple, int] = {}
            kinds: list[list] = []
            for d, t in enumerate(b["text"]):
                for _, toks in sentences(t) if field is not None and isinstance(t, str) else ():
                    if toks:
                        # A sentence that stands in many texts is scored once.
                        k = known.setdefault(tuple(x[0] for x in toks), len(kinds))
                        if k == len(kinds):
                            kinds.append(toks)
                        held.append((d, toks, k))
            marg = predict(field, f.rows(kinds)) if kinds else []
            tops, peaks = [m.argmax(axis=1) for m in marg], [passage(m) for m in marg]
            best = np.zeros((len(b), len(CATEGORIES)))
            spans: list[list] = [[] for _ in range(len(b))]
            for d, toks, n in held:
                m, top = marg[n], tops[n]
                best[d] = np.maximum(best[d], peaks[n])
                if not top.any():
                    continue
                k = 0
                while k < len(toks):
                    e = k
                    while e < len(toks) and top[e] == top[k]:
                        e += 1
                    if top[k]:
                        spans[d].append((CATEGORIES[top[k] - 1], toks[k][1], toks[e - 1][2], round(float(m[k:e, top[k]].mean()), 6)))
                    k = e
            rows = [(i, src, *map(lambda x: round(float(x), 6), best[d]), spans[d]) for d, (i, src) in enumerate(zip(b["doc_id"], b["source"]))]
            yield pd.DataFrame(rows, columns=["doc_id", "source", *CATEGORIES, "spans"])

    return spread(documents.where("doc_id is not null").select("doc_id", "source", "text")).mapInPandas(run, SCORES)


def scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return score(documents, train(documents, labels))


def found(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, category): documents whose score reaches the threshold."""
    s = scores(documents, labels)
    kinds = F.array(*[F.when(F.col(c) >= THRESHOLD, F.lit(c)) for c in CATEGORIES])
    return s.select("doc_id", F.explode(F.array_compact(kinds)).alias("category")).distinct()


def rates(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(source, n_docs, and for each category the documents concerned and their rate); the null source is one row."""
    s = scores(documents, labels)
    hits = [F.sum((F.col(c) >= THRESHOLD).cast("long")).alias(f"n_{c}") for c in CATEGORIES]
    out = s.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), *hits)
    return out.select("*", *[F.round(F.col(f"n_{c}") / F.col("n_docs"), 6).alias(f"rate_{c}") for c in CATEGORIES])
