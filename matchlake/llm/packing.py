"""Filling training sequences of fixed length with whole texts.

Method: minimum bin slack. For each sequence the longest remaining length is fixed and a subset-sum over a bitset
finds the multiset of remaining lengths that comes closest to the capacity; the counts are traced back from the
bitsets. Only lengths matter for that, so it runs on the histogram of lengths, which has at most ``capacity``
rows however large the corpus is, and a filling found once is used as often as the counts allow. Each filling
leaves some length n with fewer texts than it uses of it, at most capacity / n, or takes from a length that is there
already; so there are at most sum(1 + capacity / n) fillings, about 18,000 for 2,048. The driver sees no document.

Placing the documents is then a numbering: the r-th text of its length goes where the table of fillings says.
The numbers are made in two levels (slice of a length, then place in the slice), so a length that a third of all
texts have is no single task's work.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlake.session import written

CAPACITY = 2048
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits of the byte-level vocabulary's public pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ASCII_PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t\n\x0b\x0c\rA-Za-z0-9]+|[ \t\n\x0b\x0c\r]+(?![^ \t\n\x0b\x0c\r])|[ \t\n\x0b\x0c\r]+")
#: Slices of each length: at least so many, and one for so many texts.
_SLICES, _SLICE_TEXTS = 64, 1_000_000
#: More texts than one length ever has: makes one number of a length and a place.
_PLACES = 2**44
_CACHED_WORDS = 500_000


@lru_cache(maxsize=2)
def _encoding(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class _Lengths(dict):
    """Tokens of each piece of text that the pattern makes; a piece is encoded on its own anyway."""

    def __init__(self, vocabulary: str):
        super().__init__()
        self.encode = _encoding(vocabulary).encode_ordinary

    def __missing__(self, piece: str) -> int:
        n = len(self.encode(piece))
        if len(piece) < 40:
            if len(self) >= _CACHED_WORDS:
                self.clear()
            self[piece] = n
        return n

    def of(self, text: str) -> int:
        if text.isascii():
            return sum(map(self.__getitem__, _ASCII_PATTERN.findall(text)))
        return len(self.encode(text.encode("utf-8", "replace").decode("utf-8")))


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens) of the byte-level BPE vocabulary at ``vocabulary``; a null text has none."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lengths = _Lengths(vocabulary)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "tokens": [lengths.of(t) if t else 0 for t in batch["text"]]})

    return docs.select("doc_id", "text").where(F.col("doc_id").isNotNull()).mapInPandas(count, "doc_id bigint, tokens bigint")


def fullest(counts: dict[int, int], lengths: list[int], capacity: int) -> dict[int, int]:
    """How many of each length fill one sequence best, the longest remaining one among them.

    ``lengths``: the lengths with counts left, longest first. Lengths are added to the set of reachable sums from
    the longest on, and no more of them than are needed for the best sum, so short ones are left for later.
    """
    first = lengths[0]
    room = capacity - first
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in lengths:
        left = counts[length] - (length == first)
        if length > room or left <= 0:
            continue
        before, k = reach, 1
        most = min(left, room // length)
        while most > 0:  # binary splitting: 1, 2, 4, ... copies
            k = min(k, most)
            reach |= (reach << (k * length)) & mask
            most -= k
            k *= 2
        if reach != before:
            steps.append((length, left, before))
            if reach >> room & 1:
                break
    total = reach.bit_length() - 1
    chosen = {first: 1}
    for length, left, before in reversed(steps):
        n = 0
        while not before >> total & 1:
            total -= length
            n += 1
        if n:
            chosen[length] = chosen.get(length, 0) + n
    return chosen


def fillings(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, dict[int, int]]]:
    """(first sequence, repeats, how many of each length) until every length of ``histogram`` is used up."""
    counts = {n: c for n, c in histogram.items() if c > 0}
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError("lengths must be between 1 and the capacity")
    lengths = sorted(counts, reverse=True)
    out, sequence = [], 0
    while lengths:
        chosen = fullest(counts, lengths, capacity)
        repeats = min(counts[n] // k for n, k in chosen.items())
        out.append((sequence, repeats, chosen))
        sequence += repeats
        for n, k in chosen.items():
            counts[n] -= k * repeats
        lengths = [n for n in lengths if counts[n]]
    return out


def places(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first text, texts of it a sequence, first sequence, position, offset), by length and first text."""
    used = dict.fromkeys(histogram, 0)
    rows = []
    for sequence, repeats, chosen in fillings(histogram, capacity):
        position = offset = 0
        for length, k in sorted(chosen.items(), reverse=True):
            rows.append((length, used[length], k, sequence, position, offset))
            used[length] += k * repeats
            position, offset = position + k, offset + k * length
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)


def pack(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, part, tokens, sequence_id, position, start_token) for ``sizes``: doc_id, tokens.

    A document longer than the capacity is cut into parts of exactly the capacity and a rest (part 0, 1, ...); no
    other is split. position is the place within the sequence, from 0, start_token the offset there. Documents
    without tokens get one row with part 0 and a null sequence, position and offset. Rows that repeat an id are
    documents of their own. A null size counts as none.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    n = F.coalesce(F.col("tokens"), F.lit(0))
    last = F.greatest(F.ceil(n / capacity) - 1, F.lit(0)).cast("int")
    parts = sizes.select("doc_id", n.alias("__n"), F.explode(F.sequence(F.lit(0), last)).alias("part"))
    parts = written(parts.select("doc_id", "part", F.least(F.col("__n") - F.col("part") * capacity, F.lit(capacity)).cast("int").alias("tokens")))
    empty, items = parts.where("tokens = 0"), parts.where("tokens > 0")
    histogram = {r["tokens"]: r["c"] for r in items.groupBy("tokens").agg(F.count("*").alias("c")).collect()}  # at most capacity rows
    table = places(histogram, capacity)
    keys = table[:, 0] * _PLACES + table[:, 1]

    # Level one: how many of each length stand in each slice, and so at which number each slice begins.
    slices = max(_SLICES, -(-sum(histogram.values()) // _SLICE_TEXTS))
    items = items.withColumn("__slice", F.pmod(F.xxhash64("doc_id", "part"), F.lit(slices)).cast("int"))
    before = Window.partitionBy("tokens").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = items.groupBy("tokens", "__slice").agg(F.count("*").alias("__c")).select("tokens", "__slice", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__first"))
    # Level two: the number within the slice.
    inside = Window.partitionBy("tokens", "__slice").orderBy("doc_id", "part")
    numbered = items.withColumn("__r", F.row_number().over(inside) - 1).join(starts, ["tokens", "__slice"])  # both are there by length and slice
    numbered = numbered.select("doc_id", "part", "tokens", (F.col("__r") + F.col("__first")).alias("__r"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            length, r = batch["tokens"].to_numpy(dtype=np.int64), batch["__r"].to_numpy(dtype=np.int64)
            _, first, k, sequence, position, offset = table[np.searchsorted(keys, length * _PLACES + r, side="right") - 1].T
            step = r - first
            yield batch[["doc_id", "part", "tokens"]].assign(sequence_id=sequence + step // k, position=(position + step % k).astype(np.int32), start_token=(offset + step % k * length).astype(np.int32))

    kind = sizes.schema["doc_id"].dataType.simpleString()
    done = numbered.mapInPandas(place, f"doc_id {kind}, part int, tokens int, sequence_id bigint, position int, start_token int")
    return done.unionByName(empty.select("doc_id", "part", "tokens", *[F.lit(None).cast(done.schema[c].dataType).alias(c) for c in ("sequence_id", "position", "start_token")]))
