"""Encoding by a public byte-level BPE vocabulary.

The merge loop holds, for one word, an array of part boundaries and beside it the
rank of each adjacent pair; it scans for the least rank, deletes that boundary and
refreshes the ranks of the two neighbours. Words above ``SHORT`` bytes keep the same
arrays behind a heap, as a scan for each merge would be quadratic there.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Word pattern of the public vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHORT = 96
MEMO = 200_000
NEVER = 1 << 60


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    get = ranks.get
    starts = list(range(len(word) + 1))
    rank = [get(word[i : i + 2], NEVER) for i in range(len(word) - 1)]
    while rank:
        best = min(rank)
        if best == NEVER:
            break
        i = rank.index(best)
        del starts[i + 1]
        del rank[i]
        if i < len(rank):
            rank[i] = get(word[starts[i] : starts[i + 2]], NEVER)
        if i:
            rank[i - 1] = get(word[starts[i - 1] : starts[i + 1]], NEVER)
    return [ranks[word[a:b]] for a, b in zip(starts, starts[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    n, get = len(word), ranks.get
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank = [get(word[i : i + 2], NEVER) for i in range(n - 1)] + [NEVER]
    heap = [(r, i) for i, r in enumerate(rank) if r != NEVER]
    heapq.heapify(heap)
    gone = bytearray(n + 1)

    def refresh(i: int) -> None:
        j = after[i]
        rank[i] = get(word[i : after[j]], NEVER) if j < n else NEVER
        if rank[i] != NEVER:
            heapq.heappush(heap, (rank[i], i))

    while heap:
        r, i = heapq.heappop(heap)
        if gone[i] or rank[i] != r:
            continue
        j = after[i]
        gone[j] = 1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        refresh(i)
        if i:
            refresh(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : after[i]]])
        i = after[i]
    return out


class Encoder:
    def __init__(self, ranks: dict[bytes, int]):
        import regex

        self.ranks, self.words, self.memo = ranks, regex.compile(PATTERN), {}

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        memo, ranks = self.memo, self.ranks
        for word in self.words.findall(text or ""):
            ids = memo.get(word)
            if ids is None:
                raw = word.encode("utf-8", "surrogatepass")
                ids = [ranks[raw]] if raw in ranks else (merge_short if len(raw) <= SHORT else merge_long)(raw, ranks)
                if len(memo) >= MEMO:
                    memo.clear()
                if len(raw) <= SHORT:
                    memo[word] = ids
            out += ids
        return out


def _run(df: DataFrame, text: str, keep: list[str], vocabulary: str, result: str) -> DataFrame:
    spark = df.sparkSession
    ranks = spark.sparkContext.broadcast(load_ranks(vocabulary))
    names = [f"c{i}" for i in range(len(keep))]
    rows = df.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(text).alias("t"))
    counts = result == "n_tokens"
    schema = ", ".join([f"{n} {rows.schema[n].dataType.simpleString()}" for n in names] + [f"r {'int' if counts else 'array<int>'}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(ranks.value)
        for b in batches:
            ids = [enc.encode(t) for t in b.column("t").to_pylist()]
            out = pa.array(map(len, ids), pa.int32()) if counts else pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], out], [*names, "r"])

    out = spread(rows).mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], F.col("r").alias(result))


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids array<int>) for every row of ``df``.

    Null and empty texts give an empty list, white space is encoded as it stands, a
    special token's string is ordinary text. Repeated keys stay repeated; a null key
    stays null; an empty table gives an empty one. Other columns are not looked at.
    The vocabulary (fixed size, about 1 MB) is broadcast.
    """
    return _run(df, text, [key], vocabulary, "ids")


def count(df: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(keep..., n_tokens int): sizes in tokens, 0 for null and empty texts."""
    return _run(df, text, keep, vocabulary, "n_tokens")
