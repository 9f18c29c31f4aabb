"""Evaluation items that leak into training texts.

Method: pigeonhole edit matching. An item is split into disjoint pieces of PIECE words. A reproduction counts in runs of at
least RUN = 2 * PIECE - 1 words, and such a run, wherever it starts, holds a whole piece; a run of up to RUN + 2 words may
hold no more than one. So a text that reproduces enough words leaves at least (words needed) / (RUN + 2) pieces whole: the
error budget is the number of the others, and no text with as many pieces whole as that is missed. Pieces are looked up
exactly, and only the hits are verified, with a bit-parallel distance.

All pieces of a block of items stand in one Aho-Corasick automaton, which reads each text once, whole. The
distance counts only what is missing of the item: what a text puts between the runs is not an error, so the
recurrence is Myers's bit-vector one in its form for insertions free of charge. What it lets through is decided
exactly, by the longest chain of common runs.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = 5
SHARE = 0.5
#: Words of the items searched at once; more items are searched in several passes over the texts.
WORDS_PER_BLOCK = 2_000_000

_APOSTROPHES = "'’‘`´ʼ′＇‛"
_MARKUP = re.compile(r"</?[A-Za-z!][^<>]*>")
_ENTITY = re.compile(r"&#?\w+;")
_ASCII = {c: (chr(c) if chr(c).isalnum() else None if chr(c) == "'" or chr(c) == "`" else " ") for c in range(128)}


class _Fold(dict):
    """Translation of one code point after decomposition: letters and digits stay, marks and apostrophes go."""

    def __missing__(self, code: int):
        c = chr(code)
        if c in _APOSTROPHES or unicodedata.combining(c) or unicodedata.category(c) == "Cf":
            value = None
        else:
            value = c if c.isalnum() else " "
        self[code] = value
        return value


_FOLD = _Fold()


def words(text: str) -> list[str]:
    """Words of a text without case, accents, punctuation, apostrophes, markup and quoting marks."""
    if "&" in text:
        text = _ENTITY.sub(lambda m: html.unescape(m[0]), text)
    if "<" in text:
        text = _MARKUP.sub(" ", text)
    if text.isascii():
        return text.lower().translate(_ASCII).split()
    return unicodedata.normalize("NFKD", text.casefold()).translate(_FOLD).split()


def kept_words(item: list[str], text: list[str]) -> int:
    """How many words of ``item`` stand in ``text`` in order, anything between: bit-parallel, one step a word."""
    masks: dict[str, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for w in text:
        if m := masks.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


def chained_words(item: list[str], text: list[str], run: int = RUN) -> int:
    """Most words of ``item`` that disjoint common runs of at least ``run`` words, in order in both, can hold."""
    if len(item) < run:
        return 0
    pieces = {}
    for i in range(len(item) - run + 1):
        pieces.setdefault(tuple(item[i : i + run]), []).append(i)
    cover = [False] * len(text)
    for j in range(len(text) - run + 1):
        if tuple(text[j : j + run]) in pieces:
            cover[j : j + run] = [True] * run
    at = {}
    for i, w in enumerate(item):
        at.setdefault(w, []).append(i)
    m = len(item)
    none = [0] * (m + 1)
    rows = [none] * run  # best chain for each prefix of the item, after the last ``run`` words of the text
    length = none  # common run that ends here
    ends = none  # best chain whose last run ends here
    for j, w in enumerate(text):
        if not cover[j]:
            length = ends = none
            rows = [rows[-1]] * run
            continue
        new, nl, ne = rows[-1][:], [0] * (m + 1), [0] * (m + 1)
        for i in at.get(w, ()):
            n = nl[i + 1] = length[i] + 1
            if n >= run:
                ne[i + 1] = max(rows[-run][i + 1 - run] + run, ends[i] + 1 if n > run else 0)
        for i in range(1, m + 1):
            new[i] = max(new[i], new[i - 1], ne[i])
        rows, length, ends = [*rows[1:], new], nl, ne
    return rows[-1][m]


def piece_words(run: int) -> int:
    """The longest pieces of which every run of ``run`` words holds a whole one."""
    return (run + 1) // 2


class _Index:
    """The pieces of some items in one automaton, with what each item needs."""

    def __init__(self, items: list[tuple[int, list[str]]], run: int, share: float):
        self.run, self.items = run, dict(items)
        self.least = {i: max(run, -int(-(len(w) * share) // 1)) for i, w in items}
        size = piece_words(run)
        # A run that starts just after a piece's first word may have size - 1 words before the next piece and, after that
        # one, size - 1 more: with one whole piece it is at most 3 * size - 2 words long.
        self.pieces = {i: -(-n // (3 * size - 2)) for i, n in self.least.items()}
        held: dict[str, set[tuple[int, int]]] = {}
        for i, w in items:
            for k in range(0, len(w) - size + 1, size):
                held.setdefault(" " + " ".join(w[k : k + size]) + " ", set()).add((i, k))
        self.automaton = ahocorasick.Automaton()
        for piece, of in held.items():
            self.automaton.add_word(piece, tuple(of))
        if held:
            self.automaton.make_automaton()
        self.any = bool(held)

    def candidates(self, own: list[str]) -> list[int]:
        """The items of which the words hold as many whole pieces as a reproduction leaves."""
        hits: dict[int, set[int]] = {}
        for of in {id(of): of for _, of in self.automaton.iter(" " + " ".join(own) + " ")}.values():
            for i, k in of:
                hits.setdefault(i, set()).add(k)
        return [i for i, at in hits.items() if len(at) >= self.pieces[i]]

    def leaked(self, text: str, tally: dict[str, int] | None = None) -> list[tuple[int, int]]:
        """(item, words reproduced) for each item that the text reproduces; ``tally`` counts what each step lets through."""
        if not self.any:
            return []
        own = words(text)
        out = []
        near = [i for i in self.candidates(own) if len(self.items[i]) >= self.run]
        close = [i for i in near if kept_words(self.items[i], own) >= self.least[i]]
        for i in close:
            if (got := chained_words(self.items[i], own, self.run)) >= self.least[i]:
                out.append((i, got))
        if tally is not None:
            for step, n in (("texts", 1), ("pieces", len(near)), ("distance", len(close)), ("leaks", len(out))):
                tally[step] = tally.get(step, 0) + n
        return out


def leaks(docs: DataFrame, items: DataFrame, run: int = RUN, share: float = SHARE, block: int = WORDS_PER_BLOCK) -> DataFrame:
    """(doc_id, item_id, item_words, leaked_words): the texts that reproduce at least ``share`` of an item's words.

    ``docs``: doc_id, text; ``items``: item_id, text. The items are the stated query set: they are brought to the
    tasks in blocks of about ``block`` words, each block read against all texts. Null and empty texts leak nothing, and an
    item of fewer than ``run`` words can't be reproduced. Rows that repeat give repeated results.
    """
    read = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text")
    blocks = max(1, -(-(read.agg(F.sum(F.length("text") / 2)).head()[0] or 0) // block))
    part = F.pmod(F.xxhash64("item_id"), F.lit(int(blocks)))
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, item_words int, leaked_words int"
    out = None
    for b in range(int(blocks)):
        chosen = [(r.item_id, words(r.text)) for r in read.where(part == b).toLocalIterator()]

        def search(batches: Iterator[pd.DataFrame], chosen=chosen) -> Iterator[pd.DataFrame]:
            index = _Index(chosen, run, share)
            for batch in batches:
                rows = [(d, i, len(index.items[i]), n) for d, t in zip(batch["doc_id"], batch["text"]) for i, n in index.leaked(t)]
                if rows:
                    yield pd.DataFrame(rows, columns=["doc_id", "item_id", "item_words", "leaked_words"])

        found = texts.mapInPandas(search, schema)
        out = found if out is None else out.unionByName(found)
    return out


def leaks_by_item(found: DataFrame) -> DataFrame:
    """Per item: in how many texts it leaks, and the largest share of it in one text."""
    return found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max(F.col("leaked_words") / F.col("item_words")).alias("largest_share"))
