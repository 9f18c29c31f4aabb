"""Long spans that stand verbatim in more than one record.

Method: Rabin-Karp hashes of every window of fixed length, counted in Spark; repeated windows merge into maximal
intervals. The token is the code point, so the measure is the one asked for: characters.

Counting every window of 300 characters would shuffle as many rows as the corpus has characters. So it goes in
two passes that together lose nothing. The first hashes every window of GRAM characters and counts only the
locally smallest ones (winnowing): any common span of SPAN characters holds, at the same place in both records, a
chosen window, as SPAN = GRAM + (number of windows looked over) - 1. That leaves about one row in 75. The second
pass takes every SPAN window around the repeated ones only, and counts those in full. To find who shares, it takes
them only around the places where a common span can begin: a repeated window that follows the same chosen window at
the same distance in every record that has it is inside a span that was met before. All window hashes roll: prefix sums
over the text give every window's at once, whatever its length.

Records with equal texts are represented by the first of them and joined back at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlake.session import broadcast_if_small, cut_lineage, written

SPAN = 300
GRAM = 150
#: Candidate records, and places in all, that go to every task; beyond this the texts are joined by a shuffle.
BROADCAST_RECORDS, BROADCAST_PLACES = 100_000, 1_000_000
#: Records of one head that are paired in one task.
HEAD_ROWS = 2_000
_PRIMES = ((2**31 - 1, 1_103_515_245), (2**31 - 19, 1_664_525_003))
_BASE = 0x9E3779B97F4A7C15
_CHUNK = 1_000_000


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base % 2**64))
    out[0] = 1
    return np.multiply.accumulate(out)


def _sliding_min(a: np.ndarray, k: int) -> np.ndarray:
    """Minimum of every k neighbours, by minima from both ends of blocks of k."""
    n = len(a) - k + 1
    blocks = -(-len(a) // k)
    padded = np.full(blocks * k, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(a)] = a
    rows = padded.reshape(blocks, k)
    forward = np.minimum.accumulate(rows, axis=1).ravel()
    backward = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[k - 1 : k - 1 + n])


def chosen_windows(codes: np.ndarray, gram: int, look: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the windows of ``gram`` code points that are smallest among ``look`` neighbours.

    The hash is the polynomial one, modulo 2**64: prefix sums of code * base**i give every window's in one go,
    and the inverse of the (odd) base takes the window's place out of it.
    """
    if len(codes) < gram + look - 1:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    powers = _powers(_BASE, len(codes))
    prefix = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers, out=prefix[1:])
    starts = len(codes) - gram + 1
    value = (prefix[gram:] - prefix[:-gram]) * _powers(pow(_BASE, -1, 2**64), starts)
    value ^= value >> np.uint64(31)  # the low bits of such sums are weak
    value *= np.uint64(0xBF58476D1CE4E5B9)
    bits = np.uint64(max(1, int(starts).bit_length()))
    packed = (value >> bits << bits) | np.arange(starts, dtype=np.uint64)  # ties: the leftmost
    at = np.unique(_sliding_min(packed, look) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    return at, value[at]


def _fingerprint(batches: Iterator[pd.DataFrame], gram: int, look: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        ids, at, values, links = [], [], [], []
        for doc, text in zip(batch["doc_id"].to_numpy(), batch["text"]):
            # A text longer than a chunk goes in pieces that overlap by a whole span less one, so no window is lost.
            step = _CHUNK
            for begin in range(0, max(1, len(text) - (gram + look - 2)), step):
                piece = text[begin : begin + step + gram + look - 2]
                start, value = chosen_windows(np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), gram, look)
                if len(start):
                    ids.append(np.full(len(start), doc))
                    at.append(start + begin)
                    values.append(value)
                    # What is chosen before it and how far away, as one hash; none for the first of a piece and where
                    # the two windows leave a gap, so that the text between them is not vouched for.
                    link = np.zeros(len(start), dtype=np.uint64)
                    link[1:] = (value[:-1] ^ (np.diff(start).astype(np.uint64) * np.uint64(_BASE))) | np.uint64(1)
                    link[1:][np.diff(start) > gram] = 0
                    links.append(link)
        if ids:
            yield pd.DataFrame({"doc_id": np.concatenate(ids), "at": np.concatenate(at), "gram": np.concatenate(values).view(np.int64), "link": np.concatenate(links).view(np.int64)})


@lru_cache(4)
def _residues(prime: int, base: int, n: int) -> np.ndarray:
    """Powers of ``base`` modulo ``prime``; ``n`` is a power of two."""
    out = np.ones(1, dtype=np.uint64)
    while len(out) < n:
        step = np.uint64(int(out[-1]) * base % prime)
        out = np.concatenate([out, out * step % np.uint64(prime)])
    return out


def window_hashes(codes: np.ndarray, span: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the windows of ``span`` code points at ``starts``: one modulo 2**64, one modulo two primes.

    They depend on the windows alone, not on where they stand. Modulo 2**64 texts can be made that collide; modulo primes
    those don't.
    """
    plain = codes.astype(np.uint64) + np.uint64(1)
    n = 1 << int(len(codes)).bit_length()
    powers = _powers(_BASE, len(codes))
    prefix = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(plain * powers, out=prefix[1:])
    high = (prefix[starts + span] - prefix[starts]) * _powers(pow(_BASE, -1, 2**64), len(codes))[starts]
    low = np.zeros(len(starts), dtype=np.uint64)
    for prime, base in _PRIMES:
        p = np.uint64(prime)
        np.cumsum(plain * _residues(prime, base, n)[: len(codes)] % p, out=prefix[1:])  # each below 2**31: no overflow
        value = (prefix[starts + span] - prefix[starts]) % p * _residues(prime, pow(base, -1, prime), n)[starts] % p
        low = (low << np.uint64(31)) | value
    return high, low


def _windows(batches: Iterator[pd.DataFrame], span: int, gram: int) -> Iterator[pd.DataFrame]:
    """Every ``span`` window that holds one of the places, with its two hashes and the character before it."""
    names = ["doc_id", "at", "high", "low", "before"]
    for batch in batches:
        rows, size = [], 0
        for doc, text, places in zip(batch["doc_id"].to_numpy(), batch["text"], batch["places"]):
            places = np.asarray(places, dtype=np.int64)
            mark = np.zeros(len(text) - span + 2, dtype=np.int32)
            np.add.at(mark, np.maximum(places + gram - span, 0), 1)
            np.add.at(mark, np.minimum(places, len(text) - span) + 1, -1)
            wanted = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
            for first in range(0, len(text) - span + 1, _CHUNK):  # pieces overlap by a window less one
                starts = wanted[(wanted >= first) & (wanted < first + _CHUNK)]
                if not len(starts):
                    continue
                begin = max(0, first - 1)
                codes = np.frombuffer(text[begin : first + _CHUNK + span - 1].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                high, low = window_hashes(codes, span, starts - begin)
                before = np.where(starts > 0, codes[np.maximum(starts - begin - 1, 0)].astype(np.int64), -1).astype(np.int32)
                rows.append((np.full(len(starts), doc), starts, high.view(np.int64), low.view(np.int64), before))
                size += len(starts)
                if size > 100_000:
                    yield pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*rows)))))
                    rows, size = [], 0
        if rows:
            yield pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*rows)))))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, chars): records with equal texts have one class, named by the smallest id."""
    text = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    keyed = text.select("doc_id", F.sha2("text", 256).alias("__text"), F.length("text").alias("chars")).dropDuplicates(["doc_id"])
    first = keyed.groupBy("__text").agg(F.min("doc_id").alias("class_id"))
    return keyed.join(first, "__text").select("doc_id", "class_id", "chars")


def repeated_windows(docs: DataFrame, span: int = SPAN, gram: int = GRAM, heads: bool = False) -> tuple[DataFrame, DataFrame]:
    """(windows, members): each span window that stands in at least two class representatives, and the classes.

    windows: doc_id, at, high, low, before; with ``heads`` only those around places where a common span of two records
    can begin. members: doc_id, class_id, chars of all records that have anything in common with another.
    ``docs``: doc_id BIGINT and text; null ids and texts are left out, and of rows that repeat an id one counts.
    """
    if not 0 < gram <= span:
        raise ValueError("gram must be between 1 and span")
    docs = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & (F.length("text") >= span))
    look = span - gram + 1
    prints = written(docs.mapInPandas(lambda batches: _fingerprint(batches, gram, look), "doc_id bigint, at bigint, gram bigint, link bigint"))
    shared = prints.groupBy("gram").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("gram")
    found = written(prints.join(shared, "gram"))
    candidates = found.select("doc_id").distinct()
    members = cut_lineage(classes(docs.join(broadcast_if_small(candidates, BROADCAST_RECORDS), "doc_id", "left_semi")))
    found = found.join(members.where("doc_id = class_id").select("doc_id"), "doc_id", "left_semi")
    if heads:
        begin = found.groupBy("gram").agg(F.min("link").alias("x"), F.max("link").alias("y"), F.min(F.abs("link")).alias("none"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
        found = found.join(begin.where("a < b and (x < y or none = 0)").select("gram"), "gram")
    places = cut_lineage(found.groupBy("doc_id").agg(F.collect_set("at").alias("places")))
    few = (places.agg(F.sum(F.size("places"))).head()[0] or 0) <= BROADCAST_PLACES
    texts = docs.join(broadcast_if_small(places, BROADCAST_RECORDS) if few else places, "doc_id").dropDuplicates(["doc_id"])
    windows = written(texts.mapInPandas(lambda batches: _windows(batches, span, gram), "doc_id bigint, at bigint, high bigint, low bigint, before int"))
    repeated = windows.groupBy("high", "low").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("high", "low")
    return windows.join(repeated, ["high", "low"]).select("doc_id", "at", "high", "low", "before"), members


def _class_pairs(docs: DataFrame, span: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): (x, y), x < y, of class representatives that share a span, and the classes.

    A pair is made only where a common span begins, that is where the characters before differ or one is missing.
    Windows inside a span that everybody shares make none, so the work follows the result, not its square. Records that
    begin alike are paired in slices, so a head that a third of all records have is spread over many tasks.
    """
    windows, members = repeated_windows(docs, span, gram, heads=True)
    begins = windows.groupBy("high", "low").agg(F.min("before").alias("x"), F.max("before").alias("y"), F.count("*").alias("n")).where("x < y or x = -1")
    heads = written(windows.join(begins.select("high", "low", F.ceil(F.col("n") / HEAD_ROWS).alias("slices")), ["high", "low"]).select("high", "low", "doc_id", "before", "slices").distinct())
    a = heads.withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.col("slices"))).alias("a")
    b = heads.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1))).alias("b")
    meet = (F.col("a.high") == F.col("b.high")) & (F.col("a.low") == F.col("b.low")) & (F.col("a.slice") == F.col("b.slice")) & (F.col("a.doc_id") < F.col("b.doc_id"))
    pairs = a.join(b, meet & ((F.col("a.before") != F.col("b.before")) | (F.col("a.before") == -1))).select(F.col("a.doc_id").alias("x"), F.col("b.doc_id").alias("y")).distinct()
    return pairs, members


def shared_pairs(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(doc_id_a, doc_id_b), smaller id first: the records that share a span of at least ``span`` characters."""
    pairs, members = _class_pairs(docs, span, gram)
    left = members.select(F.col("class_id").alias("x"), F.col("doc_id").alias("l"))
    right = members.select(F.col("class_id").alias("y"), F.col("doc_id").alias("r"))
    across = pairs.join(left, "x").join(right, "y").select("l", "r")
    copies = members.groupBy("class_id").count().where("count > 1").select(F.col("class_id").alias("x"))
    inside = copies.join(left, "x").join(right.withColumnRenamed("y", "x"), "x").where("l < r").select("l", "r")
    return across.unionByName(inside).select(F.least("l", "r").alias("doc_id_a"), F.greatest("l", "r").alias("doc_id_b")).distinct()


def shared_links(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(doc_id, class_id, links): one row for each record that shares a span with another: its class of equal texts, named
    by the smallest id, and the number of other records it shares a span with. Copies are counted, not paired."""
    pairs, members = _class_pairs(docs, span, gram)
    sizes = members.where(F.col("chars") >= span).groupBy("class_id").agg(F.count("*").alias("n"))
    both = pairs.select(F.col("x").alias("class_id"), F.col("y").alias("other")).unionByName(pairs.select(F.col("y").alias("class_id"), F.col("x").alias("other")))
    across = both.join(sizes.select(F.col("class_id").alias("other"), "n"), "other").groupBy("class_id").agg(F.sum("n").alias("across"))
    links = sizes.join(across, "class_id", "left").select("class_id", (F.coalesce("across", F.lit(0)) + F.col("n") - 1).alias("links")).where("links > 0")
    return members.join(links, "class_id").select("doc_id", "class_id", "links")


def shared_intervals(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(doc_id, begin, end): the maximal intervals of each record (from 0, end exclusive) that stand elsewhere too."""
    windows, members = repeated_windows(docs, span, gram)
    windows = windows.select("doc_id", "at").distinct()
    order = Window.partitionBy("doc_id").orderBy("at")
    marked = windows.withColumn("__new", (F.col("at") > F.lag("at").over(order) + span) | F.lag("at").over(order).isNull())
    island = marked.withColumn("__island", F.sum(F.col("__new").cast("int")).over(order))
    merged = island.groupBy("doc_id", "__island").agg(F.min("at").alias("begin"), (F.max("at") + span).alias("end"))
    sizes = members.groupBy("class_id").agg(F.count("*").alias("n"))
    whole = members.where(F.col("chars") >= span).join(sizes.where("n > 1"), "class_id").select("doc_id", F.lit(0).cast("bigint").alias("begin"), F.col("chars").cast("bigint").alias("end"))
    part = merged.join(sizes.where("n = 1"), merged["doc_id"] == sizes["class_id"]).select("doc_id", "begin", "end")
    return whole.unionByName(part)


def shared_share(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(doc_id, chars, shared_chars, share) for each record of which some span stands elsewhere."""
    held = shared_intervals(docs, span, gram).groupBy("doc_id").agg(F.sum(F.col("end") - F.col("begin")).alias("shared_chars"))
    size = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.length("text")).cast("bigint").alias("chars"))
    return held.join(size, "doc_id").select("doc_id", "chars", "shared_chars", (F.col("shared_chars") / F.col("chars")).alias("share"))
