"""Resolution of newly seen players against known identities by external id and name similarity.

The known identities are the stated query set: they are brought to the tasks in blocks of bounded size, and every
candidate keeps its best two scores of each block, which a second, small aggregation merges. No pair leaves a task.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.session import spread

THRESHOLD, SHORT_EXTRA, SHORT_LENGTH, MARGIN = 0.82, 0.08, 4, 0.05
COUNTRY_FACTOR, BIRTH_FACTOR, CONFLICT_FLOOR = 0.7, 0.6, 0.3
BLOCK = 5000


def _letters(names: list[str]) -> np.ndarray:
    """How often each letter (by code modulo 64) stands in each name; bounds a similarity from above."""
    out = np.zeros((len(names), 64), dtype=np.int16)
    for i, name in enumerate(names):
        np.add.at(out[i], [ord(c) % 64 for c in name], 1)
    return out


class _Bounds:
    """Upper bounds of a name's similarity to many others at once.

    What a similarity counts as equal is a common subsequence, so it can't be longer than the longest one. That is found for
    all names together, a bit a letter, in one step a letter of the name; for names longer than a word of bits, the common
    letters are counted instead.
    """

    def __init__(self, names: list[str]):
        self.letters, self.sizes = _letters(names), np.array([len(n) for n in names])
        self.long = self.sizes > 64
        self.within = np.array([(1 << min(len(n), 64)) - 1 for n in names], dtype=np.uint64)
        self.masks: dict[str, np.ndarray] = {}
        for i, name in enumerate(names):
            for k, c in enumerate(name[:64]):
                if c not in self.masks:
                    self.masks[c] = np.zeros(len(names), dtype=np.uint64)
                self.masks[c][i] |= np.uint64(1 << k)

    def most(self, name: str) -> np.ndarray:
        v = np.full(len(self.sizes), np.iinfo(np.uint64).max, dtype=np.uint64)
        for c in name:
            if (m := self.masks.get(c)) is not None:
                u = v & m
                v = (v + u) | (v - u)  # the carry out of the top bit is of no use
        common = np.bitwise_count(~v & self.within).astype(np.int64)
        if self.long.any():
            common = np.where(self.long, np.minimum(self.letters, _letters([name])[0]).sum(axis=1), common)
        return 2 * common / (self.sizes + len(name))


def _best_two(batches: Iterator[pd.DataFrame], block: list[tuple]) -> Iterator[pd.DataFrame]:
    """The best two scores of each candidate.

    Names are compared in order of the bound of their similarity, times the factor of what differs, until it falls below the
    second best score: no name after that can matter.
    """
    flat = [(iid, name, country, born) for iid, names, country, born in block for name in names]
    bounds = _Bounds([f[1] for f in flat])
    lands = np.array([f[2] or "" for f in flat], dtype=object)
    births = np.array([str(f[3]) if f[3] else "" for f in flat], dtype=object)
    for batch in batches:
        rows = []
        for cid, name, country, born in zip(batch["candidate_id"], batch["normalized_name"], batch["country"], batch["birth_date"]):
            if not name or not flat:
                continue
            factor = np.where((lands != (country or "")) & (lands != "") & bool(country), COUNTRY_FACTOR, 1.0)
            factor = factor * np.where((births != str(born)) & (births != "") & bool(born), BIRTH_FACTOR, 1.0)
            most = bounds.most(name) * factor
            found: dict[str, float] = {}
            second = 0.0
            for k in np.argsort(-most, kind="stable"):
                if most[k] < second or most[k] == 0:
                    break
                iid, other, _, _ = flat[k]
                score = difflib.SequenceMatcher(None, name, other).ratio() * factor[k]
                found[iid] = max(found.get(iid, 0.0), min(1.0, score))
                if len(found) > 1:
                    second = sorted(found.values())[-2]
            rows += [(cid, s, i) for i, s in sorted(found.items(), key=lambda f: (-f[1], f[0]))[:2]]
        if rows:
            yield pd.DataFrame(rows, columns=["candidate_id", "score", "identity_id"])


def resolve(candidates: DataFrame, identities: DataFrame, block: int = BLOCK) -> DataFrame:
    """(candidate_id, outcome, identity_id, score, margin) for every candidate.

    ``candidates``: candidate_id, normalized_name, country, birth_date, external_provider, external_player_id;
    ``identities``: id, normalized_name, aliases, country, birth_date, external_ids. An external id that an identity
    has settles it: matched, or rejected if the names are too unlike. Else the best similarity (of name and aliases,
    lowered where known countries or birth dates differ) decides: created below the threshold, ambiguous if the
    next is too close, else matched. Without identities everyone is created. Nulls don't lower a score. The margin is the
    distance to the next best identity, or to 0 where there is none; without a name or a common letter both are null.
    """
    listed = identities.select(F.col("id").alias("identity_id"), F.array_compact(F.concat(F.array("normalized_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("names"), F.explode("external_ids").alias("x"))
    owner = listed.groupBy(F.col("x.provider").alias("p"), F.col("x.provider_player_id").alias("k")).agg(F.min(F.struct("identity_id", "names")).alias("o"))
    own = candidates.join(owner, (F.col("external_provider") == F.col("p")) & (F.col("external_player_id") == F.col("k")), "left")
    kind = candidates.schema["candidate_id"].dataType.simpleString()

    def alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            best = [max((difflib.SequenceMatcher(None, n or "", o).ratio() for o in names), default=0.0) for n, names in zip(batch["normalized_name"], batch["names"])]
            yield pd.DataFrame({"candidate_id": batch["candidate_id"], "identity_id": batch["identity_id"], "alike": best})

    exact = own.where("o is not null").select("candidate_id", "normalized_name", "o.identity_id", "o.names").mapInPandas(alike, f"candidate_id {kind}, identity_id string, alike double")
    good = F.col("alike") >= CONFLICT_FLOOR
    settled = exact.select("candidate_id", F.when(good, "matched").otherwise("rejected").alias("outcome"), F.when(good, F.col("identity_id")).alias("identity_id"), F.when(good, 1.0).alias("score"), F.lit(None).cast("double").alias("margin"))

    rest = spread(own.where("o is null").select("candidate_id", "normalized_name", "country", "birth_date"))
    blocks = max(1, -(-identities.count() // block))
    part = F.pmod(F.xxhash64("id"), F.lit(blocks))
    scored = None
    for b in range(blocks):
        chosen = [(r.id, [n for n in [r.normalized_name, *(r.aliases or [])] if n], r.country, r.birth_date) for r in identities.where(part == b).toLocalIterator()]
        found = rest.mapInPandas(lambda batches, chosen=chosen: _best_two(batches, chosen), f"candidate_id {kind}, score double, identity_id string")
        scored = found if scored is None else scored.unionByName(found)
    top = scored.groupBy("candidate_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "identity_id"))).alias("t"))  # two a block
    second = F.coalesce(-F.try_element_at("t", F.lit(2))["s"], F.lit(0.0))
    top = top.select("candidate_id", (-F.col("t")[0]["s"]).alias("score"), F.col("t")[0]["identity_id"].alias("best"), second.alias("second"))
    rows = rest.join(top, "candidate_id", "left")
    need = F.lit(THRESHOLD) + F.when(F.length("normalized_name") <= SHORT_LENGTH, SHORT_EXTRA).otherwise(0.0)
    margin = F.col("score") - F.col("second")
    outcome = F.when(F.col("score").isNull() | (F.col("score") < need), "created").when(margin < MARGIN, "ambiguous").otherwise("matched")
    decided = rows.select("candidate_id", outcome.alias("outcome"), F.when(outcome == "matched", F.col("best")).alias("identity_id"), "score", margin.alias("margin"))
    return settled.unionByName(decided)
