"""Feature snapshots: all that was known about a match at its cutoff, one row a match.

A row of a match's side is both: a part of its player's history and a question about it. The rows of a player are brought
together once; the history in order of time, running totals along it give windows, streak, form, volatility and rest, and those
along the history of each pair the meetings. The two sides of a match then meet. Both exchanges carry narrow compressed columns
and only the sums that are asked for. Players with so many rows that they would be too much for one task go the way of
``rolling`` and ``matchup``, in blocks of time.

No snapshot lists its sources: what went into it is bound by running digests of the sources' ids, so the work grows with
matches and snapshots, not with their product. The union of the two histories and the meetings needs no list either: what both
sides have in common is their meetings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from matchlake.functions.columns import DAY_US, HOUR_US, clamp, digests, iso_text, short_hash
from matchlake.operators import asof, matchup, parts, rolling
from matchlake.operators.perspective import perspectives
from matchlake.session import written

SCHEMA_VERSION = BUILDER_VERSION = "1.0.0"
MIN_OBSERVATIONS = 1
FULL = 100
#: A player with more rows (matches and rankings) is cut into blocks of time.
HEAVY = 100_000
#: Rows that are worked on at once.
CHUNK = 100_000
#: What the scoring of matches has no place for, of a snapshot.
UNCONVERTIBLE = (
    "player_a_features.windows", "player_b_features.windows", "player_a_features.recency_weighted_win_rate", "player_b_features.recency_weighted_win_rate",
    "player_a_features.volatility_score", "player_b_features.volatility_score", "matchup_features.competition_win_rate_a", "matchup_features.format_win_rate_a",
)
#: Columns of a side, of the sums over its history but those of the windows, and of a pair.
SIDE = {"complete": "bigint", "d0": "bigint", "d1": "bigint", "newest_us": "bigint", "recency_weighted_win_rate": "double", "volatility": "double", "matches_24h": "bigint", "matches_7d": "bigint", "result_streak": "bigint", "ranking": "int"}
NARROW = ("n", "decided", "wins")
PAIR = (*matchup.SUMS, "recent_decided", "recent_wins", "last_us", *[f"{name}_{x}" for name in ("competition", "format") for x in NARROW], "complete", "d0", "d1")


def _bound() -> dict[str, Column]:
    return {"complete": F.col("completeness").cast("bigint"), **digests(F.col("match_id"))}


def _before(group: np.ndarray, at: np.ndarray, asked: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the rows of the asked groups begin, and where those before the cut end; rows in order of (group, at)."""
    times = np.unique(at)
    key, base = group * (len(times) + 1) + np.searchsorted(times, at), asked * (len(times) + 1)
    return np.searchsorted(key, base), np.searchsorted(key, base + np.searchsorted(times, cut))


def _running(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values)])


def _ints(column: pa.ChunkedArray, null: int = 0) -> np.ndarray:
    return pc.fill_null(column.cast(pa.int64()), null).to_numpy(zero_copy_only=False)


def _codes(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """Numbers for the values of several columns of one type, -1 for null."""
    coded = pa.chunked_array([c for column in columns for c in column.chunks], columns[0].type).combine_chunks().dictionary_encode().indices
    return np.split(_ints(coded, -1), np.cumsum([len(c) for c in columns])[:-1])


def _digests(ids: pa.ChunkedArray) -> dict[str, np.ndarray]:
    """``functions.columns.digests`` of the ids."""
    each = np.frombuffer(b"".join(hashlib.md5(str(x).encode(), usedforsecurity=False).digest() for x in ids.to_pylist()), np.uint8).reshape(-1, 16).astype(np.int64)
    return {f"d{k}": (each[:, 5 * k : 5 * k + 5] << np.array([32, 24, 16, 8, 0])).sum(axis=1) for k in (0, 1)}


def _known(t: pa.Table, windows: Sequence[int], sums: Sequence[str]) -> pa.Table:
    """What was known to each question (row with a cut) of some players' rows; all rows of these players."""
    t = t.append_column("seg", pa.array(_codes(t["player"])[0]))
    ranked, rows = t.filter(pc.equal(t["kind"], 1)), t.filter(pc.equal(t["kind"], 0))
    rows = rows.append_column("tie", rows["match_id"].cast(pa.string()))
    hist = rows.filter(pc.is_valid(rows["at"]))
    hist = hist.take(pc.sort_indices(hist, sort_keys=[(c, "ascending") for c in ("seg", "at", "tie")]))
    ask = rows.filter(pc.is_valid(rows["cut"]))
    seg, at, asked, cut = _ints(hist["seg"]), _ints(hist["at"]), _ints(ask["seg"]), _ints(ask["cut"])
    first, end = _before(seg, at, asked, cut)
    some = end > first
    last = np.where(some, end - 1, 0)
    pick = lambda values, where, ok: pa.array(values[where] if len(values) else np.zeros(len(where), np.int64), mask=~ok)
    measured = {x: np.ones(len(seg), np.int64) if x == "n" else _ints(hist[x]) for x in {*sums, *matchup.SUMS, "points_for", "points_against"}}
    bound = {"complete": _ints(hist["complete"]), **_digests(hist["match_id"])}
    out = {"match_id": ask["match_id"], "first": ask["first"], "player": ask["player"], "cut": cut}

    running = {x: _running(v) for x, v in (measured | bound).items()}
    for size in (0, *windows):
        begin = np.maximum(end - size, first) if size else first
        out |= {f"w{size}_{x}": running[x][end] - running[x][begin] for x in sums}
    out |= {x: running[x][end] - running[x][first] for x in bound}
    out["newest_us"] = pick(at, last, some)
    for name, hours in (("matches_24h", 24), ("matches_7d", 168)):
        out[name] = end - _before(seg, at, asked, cut - hours * HOUR_US)[1]

    decided, won, total = measured["decided"] > 0, measured["wins"], measured["points_for"] + measured["points_against"]
    result = np.where(decided, won, 2)
    place = np.arange(1, len(seg) + 1)
    marks = [np.concatenate([[0], np.maximum.accumulate(np.where(result == r, place, 0))]) if len(seg) else np.zeros(1, np.int64) for r in (0, 1, 2)]
    n, (lost, wins, none) = end - first, [np.maximum(m[end] - first, 0) for m in marks]
    out["result_streak"] = np.where(n == 0, 0, np.where(wins == n, n - np.maximum(lost, none), np.where(lost == n, np.maximum(wins, none) - n, 0)))

    # Sums of doubles begin anew with each player, as differences would lose digits.
    score = np.clip(won * 100.0 + (measured["points_for"] - measured["points_against"]) / np.where(total == 0, 1, total) * 15.0 * (total != 0), 0.0, 100.0) - 50
    weight = np.exp2((at - rolling._EPOCH_US) / (rolling.HALF_LIFE_DAYS * DAY_US))
    values = np.where(decided[:, None], np.stack([weight, weight * won, score, score * score], axis=1), 0.0)
    added = np.zeros((len(seg) + 1, 4))
    edges = np.flatnonzero(np.diff(seg, prepend=-1, append=-1)) if len(seg) else []
    for low, high in zip(edges[:-1], edges[1:]):
        np.cumsum(values[low:high], axis=0, out=added[low + 1 : high + 1])
    w, ww, perf, perf2 = np.where(some[:, None], added[end], 0.0).T
    count = running["decided"][end] - running["decided"][first]
    safe = np.maximum(count, 1)
    with np.errstate(all="ignore"):
        out["recency_weighted_win_rate"] = pa.array(ww / w, mask=count == 0)
        out["volatility"] = pa.array(np.minimum(1.0, np.sqrt(np.maximum(0.0, perf2 / safe - (perf / safe) ** 2)) / 50), mask=count < 2)

    ranked = ranked.take(pc.sort_indices(ranked, sort_keys=[(c, "ascending") for c in ("seg", "at", "rank_id", "ranking")]))
    begin, stop = _before(_ints(ranked["seg"]), _ints(ranked["at"]), asked, cut)
    out["ranking"] = ranked["ranking"].take(pa.array(stop - 1, mask=stop == begin)).cast(pa.int32())

    mine = _ints(ask["first"]) == 1
    opponents, others = _codes(hist["opponent"], ask["opponent"])
    width = max(opponents.max(initial=0), others.max(initial=0)) + 1
    narrow = {}
    for name, column in (("", None), ("competition_", "competition_id"), ("format_", "best_of")):
        group, asks, real, usable = seg * width + opponents, asked * width + others, opponents >= 0, mine & (others >= 0)
        if column:
            a, b = _codes(hist[column], ask[column])
            many = max(a.max(initial=0), b.max(initial=0)) + 1
            group, asks, real, usable = group * many + a, asks * many + b, real & (a >= 0), usable & (b >= 0)
        both = np.unique(np.concatenate([group[real], asks[usable]]), return_inverse=True)[1]
        group, asks = both[: real.sum()], both[real.sum() :]
        order = np.flatnonzero(real)[np.argsort(group, kind="stable")]
        low, high = _before(np.sort(group), at[order], asks, cut[usable])
        over = lambda v, start: v[high] - v[start]  # noqa: B023, E731
        found = {x: over(_running(measured[x][order]), low) for x in (NARROW if column else matchup.SUMS)}
        if not column:
            found |= {x: over(_running(bound[x][order]), low) for x in bound}
            found |= {f"recent_{x}": over(_running(measured[x][order]), np.maximum(high - matchup.RECENT, low)) for x in ("decided", "wins")}
        for x, v in found.items():
            narrow[name + x] = _at(v, usable)
        if not column:
            met = high > low
            narrow["last_us"] = _at(at[order][high[met] - 1], np.isin(np.arange(len(asked)), np.flatnonzero(usable)[met]))
    out |= {f"h_{x}": narrow[x] for x in PAIR}
    keep = pa.array(~mine | (others >= 0))
    return pa.table({k: v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v) for k, v in out.items()}).filter(keep)


def _at(values: np.ndarray, where: np.ndarray) -> pa.Array:
    out = np.zeros(len(where), np.int64)
    out[where] = values
    return pa.array(out, mask=~where)


def _light(rows: DataFrame, count: int, schema: StructType, windows: Sequence[int], sums: Sequence[str]) -> DataFrame:
    """The sides (columns of ``schema``) of players whose rows fit into one task."""

    def then(t: pa.Table) -> Iterator[pa.Table]:
        players = _codes(t["player"])[0]
        order = np.argsort(players, kind="stable")
        starts = np.flatnonzero(np.diff(players[order], prepend=-1))
        cuts = [0]
        for start, stop in zip(starts, [*starts[1:], len(order)]):
            if stop - cuts[-1] > CHUNK and start > cuts[-1]:
                cuts.append(start)
        for low, high in zip(cuts, [*cuts[1:], len(order)]):
            yield _known(t.take(pa.array(order[low:high])), windows, sums)

    return parts.by_part(rows, F.col("player"), parts.parts_for(rows, count), then, schema)


def _heavy(rows: DataFrame, rankings: DataFrame | None, windows: Sequence[int], sums: Sequence[str]) -> DataFrame:
    """The same for players with any number of rows, in blocks of time."""
    seen = written(rows.where("at is not null").drop("cut", "first").withColumnRenamed("complete", "completeness"))
    probes = rows.where("cut is not null").select("player", "opponent", F.col("cut").alias("at"), F.struct("match_id", "first").alias("probe"), "competition_id", "best_of")
    measures = {x: c for x, c in rolling.measures().items() if x in {*sums, *NARROW}}
    line = written(rolling._timeline(seen, probes.select("player", "at", "probe"), ["player"], {**measures, **rolling.decayed(), **_bound(), "result": F.coalesce(F.col("won"), F.lit(2)).cast("bigint")}, rolling.BLOCK_DAYS))
    kept = line.where("__hist = 0")
    past = line.where("__hist = 1").select(F.col("player").alias("__p"), F.col("n").alias("__rn"), F.col("at").alias("__at"), F.struct(*sums).alias("then"))
    same = F.col("player") == F.col("__p")
    mean = F.col("perf") / F.col("decided")
    out = kept.withColumns({f"w0_{x}": F.col(x) for x in sums})
    for size in windows:
        out = out.join(past.drop("__at"), same & (F.col("n") - size == F.col("__rn")), "left").withColumns({f"w{size}_{x}": F.col(x) - F.coalesce(f"then.{x}", F.lit(0)) for x in sums}).drop("__p", "__rn", "then")
    out = out.join(past.drop("then"), same & (F.col("n") == F.col("__rn")), "left").withColumns({
        "newest_us": F.col("__at"), "recency_weighted_win_rate": F.when(F.col("decided") > 0, F.col("ww") / F.col("w")),
        "volatility": F.when(F.col("decided") >= 2, F.least(F.lit(1.0), F.sqrt(F.greatest(F.lit(0.0), F.col("perf2") / F.col("decided") - mean * mean)) / 50)), "cut": F.col("at"),
    }).select("probe", "player", "cut", *[f"w{size}_{x}" for size in (0, *windows) for x in sums], *[c for c in SIDE if c not in ("matches_24h", "matches_7d", "result_streak", "ranking")])
    out = out.join(rolling.rest_and_workload(seen, probes).select("probe", "matches_24h", "matches_7d"), "probe").join(rolling.streaks(line, "result").select("probe", "result_streak"), "probe")
    out = out.withColumn("ranking", F.lit(None).cast("int")) if rankings is None else out.join(asof.latest(rankings, probes, ["player"], ["ranking"], "id").select("probe", "ranking"), "probe")
    asked = probes.where("probe.first")
    met = matchup.meeting_sums(seen, asked).drop("at")
    held = rolling._timeline(matchup.meetings(seen), asked.select("player", "opponent", "at", "probe"), ["player", "opponent"], _bound(), rolling.BLOCK_DAYS).where("__hist = 0").select("probe", "complete", "d0", "d1")
    pair = met.join(held, "probe").select("probe", *[F.col(x).alias(f"h_{x}") for x in PAIR])
    return out.join(pair, "probe", "left").where("not probe.first or h_n is not null").select("probe.match_id", "probe.first", *[c for c in [*out.columns, *pair.columns] if c != "probe"])


def _sides(matches: DataFrame, rankings: DataFrame | None, policy_us: str, windows: Sequence[int], sums: Sequence[str]) -> DataFrame:
    """Two rows for each match with a winner: match_id, first, player, cut, the ``sums`` of each window, SIDE and, of the first
    side, PAIR."""
    m = matches
    complete = F.coalesce(F.col("completeness"), F.lit(0)) if "completeness" in m.columns else F.lit(FULL)
    views = perspectives(m, {"complete": complete.cast("bigint"), "cut": F.when(F.col("winner").isNotNull(), F.col(policy_us))})
    measures = {n: c for n, c in rolling.measures().items() if n in {*sums, *matchup.SUMS, "points_for", "points_against"} and n != "n"}
    rows = views.select(F.lit(0).alias("kind"), "player", "opponent", "match_id", "first", "at", "cut", "complete", "competition_id", "best_of", *[c.alias(n) for n, c in measures.items()], F.lit(None).cast("bigint").alias("rank_id"), F.lit(None).cast("int").alias("ranking"))
    player = m.schema["player_a"].dataType
    if rankings is not None:
        rankings = rankings.where("player is not null and at is not null").withColumn("player", F.col("player").cast(player))
        ranked = rankings.select(F.lit(1).alias("kind"), "player", "at", F.col("id").alias("rank_id"), F.col("ranking").cast("int").alias("ranking"))
        every = rows.drop("rank_id", "ranking").unionByName(ranked, allowMissingColumns=True)
    else:
        every = rows
    counts = m.select(F.explode(F.array("player_a", "player_b")).alias("player"))
    counts = counts if rankings is None else counts.unionByName(rankings.select("player"))
    many = written(counts.where("player is not null").groupBy("player").agg(F.count("*").alias("rows")).where(F.col("rows") > HEAVY))
    made = StructType.fromDDL(", ".join(["first boolean", "cut bigint", *[f"w{size}_{x} bigint" for size in (0, *windows) for x in sums], *[f"{x} {kind}" for x, kind in SIDE.items()], *[f"h_{x} bigint" for x in PAIR]]))
    schema = StructType().add("match_id", m.schema["id"].dataType).add("player", player)
    for field in made:
        schema = schema.add(field)
    total = counts.count()
    if many.isEmpty():
        return _light(every, total, schema, windows, sums)
    light = _light(every.join(many.select("player"), "player", "left_anti").select(every.columns), total, schema, windows, sums)
    of = lambda df: df.join(many.select("player"), "player", "left_semi")
    return light.unionByName(_heavy(of(views), None if rankings is None else of(rankings), windows, sums))


def _together(sides: DataFrame, matches: int) -> DataFrame:
    """The two sides of each match in one row: match_id, cut, a_..., b_... and h_...."""
    of = [c for c in sides.columns if c not in ("match_id", "first", "cut") and not c.startswith("h_")]
    pair = [c for c in sides.columns if c.startswith("h_")]
    schema = StructType([sides.schema["match_id"], sides.schema["cut"]])
    for s in "ab":
        for c in of:
            schema = schema.add(f"{s}_{c}", sides.schema[c].dataType)
    for c in pair:
        schema = schema.add(sides.schema[c])

    def then(t: pa.Table) -> Iterator[pa.Table]:
        one = t.filter(t["first"]).select(["match_id", "cut", *of, *pair]).rename_columns(["match_id", "cut", *[f"a_{c}" for c in of], *pair])
        two = t.filter(pc.invert(t["first"])).select(["match_id", *of]).rename_columns(["match_id", *[f"b_{c}" for c in of]])
        yield one.join(two, "match_id", join_type="inner", use_threads=False)

    return parts.by_part(sides, F.col("match_id"), parts.parts_for(sides, matches), then, schema)


def snapshots(matches: DataFrame, rankings: DataFrame | None = None, policy_us: str = "scheduled_us", of_windows: Sequence[str] | None = None) -> DataFrame:
    """(target_match_id, as_of_us, player_a_id, player_b_id, player_a_features, player_b_features, matchup_features,
    provenance) of each match with a winner, at the time in ``policy_us``.

    ``matches``: as for ``perspectives``, with completeness (0 to 100) if known; ``rankings``: player, at, id, ranking. What a
    side has no data for is null, and named in provenance.missing_feature_names. The quality is the mean completeness of all
    sources (100 without any), less 15 for each side without enough observations and 5 without meetings. ``of_windows``: the
    features of each window that are asked for, by name; all where it is None.
    """
    names = [x for x in rolling.window_formulas(F.col) if of_windows is None or x in of_windows]
    sums = ["n", "decided", "wins"]
    formulas = rolling.window_formulas(lambda x: sums.append(x) or F.lit(1))
    for x in names:
        formulas[x]()
    sums = list(dict.fromkeys(sums))
    windows = (0, *rolling.WINDOWS)
    m = written(matches)
    rows = _together(_sides(m, rankings, policy_us, rolling.WINDOWS, sums), 2 * m.count())
    c = F.col
    window = lambda s, n: rolling.window_formulas(lambda x: c(f"{s}_w{n}_{x}"))
    meeting = lambda x: c("cut") if x == "at" else c(f"h_{x}")
    rest = {s: (c("cut") - c(f"{s}_newest_us")) / HOUR_US for s in "ab"}
    minus = lambda f: c(f"a_{f}") - c(f"b_{f}")
    observed = {s: c(f"{s}_w0_n") for s in "ab"}
    rate = {s: window(s, 0)["win_rate"]() for s in "ab"}
    sources = observed["a"] + observed["b"] - c("h_n")
    quality = F.coalesce((c("a_complete") + c("b_complete") - c("h_complete")).cast("double") / F.when(sources > 0, sources), F.lit(float(FULL)))
    few = {s: observed[s] < MIN_OBSERVATIONS for s in "ab"}
    alone = c("h_n") == 0
    warnings = F.array_compact(F.array(*[F.when(few[s], F.lit(f"player_{s}: too few observations")) for s in "ab"], F.when(alone, F.lit("no meetings"))))
    for low, points in ((few["a"], 15.0), (few["b"], 15.0), (alone, 5.0)):
        quality = quality - F.when(low, points).otherwise(0.0)
    missing = F.array_compact(F.array(
        *[F.when(rate[s].isNull(), F.lit(f"player_{s}.win_rate")) for s in "ab"], *[F.when(c(f"{s}_recency_weighted_win_rate").isNull(), F.lit(f"player_{s}.recency_weighted_win_rate")) for s in "ab"],
        F.when(c("h_decided") > 0, F.lit(None)).otherwise(F.lit("matchup.player_a_win_rate")),
    ))
    bound = short_hash(F.concat_ws("|", *[x.cast("string") for s in ("a", "b", "h") for x in (c("h_n") if s == "h" else observed[s], c(f"{s}_d0"), c(f"{s}_d1"))]))
    iso = iso_text(F.timestamp_micros(c("cut")))
    given = lambda s: F.struct(
        c(f"{s}_player").alias("player_id"), F.array(*[F.struct(F.lit(n).alias("window_size"), *[window(s, n)[x]().alias(x) for x in names]) for n in windows]).alias("windows"), c(f"{s}_recency_weighted_win_rate").alias("recency_weighted_win_rate"), c(f"{s}_volatility").alias("volatility"),
        rest[s].alias("rest_hours"), *[c(f"{s}_{x}").alias(x) for x in ("matches_24h", "matches_7d", "result_streak", "ranking")], observed[s].alias("observation_count"),
    )
    pair = F.struct(
        *matchup.meeting_features(meeting), (rate["a"] - rate["b"]).alias("form_differential"), (rest["a"] - rest["b"]).alias("rest_differential_hours"), minus("matches_7d").alias("workload_differential"),
        minus("volatility").alias("volatility_differential"), (c("b_ranking") - c("a_ranking")).cast("double").alias("ranking_differential"),
    )
    provenance = F.struct(
        c("cut").alias("cutoff_us"), c("repository_fingerprint"), short_hash(F.concat_ws("|", c("match_id").cast("string"), c("a_player").cast("string"), c("b_player").cast("string"), iso, F.lit(SCHEMA_VERSION), F.lit(BUILDER_VERSION), c("repository_fingerprint"))).alias("input_fingerprint"),
        F.lit(SCHEMA_VERSION).alias("feature_schema_version"), F.lit(BUILDER_VERSION).alias("builder_version"), clamp(quality, 0.0, float(FULL)).alias("data_quality_score"), warnings.alias("warnings"), missing.alias("missing_feature_names"),
        F.greatest("a_newest_us", "b_newest_us").alias("newest_source_us"),
    )
    rows = rows.withColumn("repository_fingerprint", bound)
    return rows.select(c("match_id").alias("target_match_id"), c("cut").alias("as_of_us"), c("a_player").alias("player_a_id"), c("b_player").alias("player_b_id"), given("a").alias("player_a_features"), given("b").alias("player_b_features"), pair.alias("matchup_features"), provenance.alias("provenance"))


def training_rows(examples: DataFrame, of: DataFrame) -> DataFrame:
    """Examples (match_id, label) with the snapshot of their match as features, as rows to be exported: id, target, as_of,
    sides, label, versions and fingerprint beside the features."""
    rows = examples.select("match_id", "label").join(of, F.col("match_id") == F.col("target_match_id"))
    return rows.select(
        F.concat(F.lit("ex-"), F.col("match_id").cast("string")).alias("id"), F.col("match_id").cast("string").alias("target_match_id"), iso_text(F.timestamp_micros("as_of_us")).alias("as_of"), "player_a_id", "player_b_id",
        (F.col("label") == 1).alias("player_a_won"), F.col("provenance.feature_schema_version").alias("feature_schema_version"), F.col("provenance.builder_version").alias("builder_version"), F.col("provenance.input_fingerprint").alias("provenance_fingerprint"),
        F.struct("player_a_features", "player_b_features", "matchup_features", F.col("provenance").withField("cutoff", F.regexp_replace(iso_text(F.timestamp_micros("as_of_us")), r"\+00:00$", "Z")).dropFields("cutoff_us").alias("provenance")).alias("features"),
    )


def engine_inputs(of: DataFrame) -> DataFrame:
    """(target_match_id, wins_a, wins_b, last_played_us, unconvertible): what a snapshot can give to scoring a match.

    Wins are the meetings times the rate, rounded half to even; meetings without a result count for the second side, as the
    rate leaves them out and the number of meetings does not. Without meetings or a rate there are no wins and no time.
    """
    met, won = F.col("matchup_features.meetings"), F.col("matchup_features.win_rate_a")
    some = (met > 0) & won.isNotNull()
    a = F.when(some, F.bround(met * won, 0).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    ago = F.round(F.col("matchup_features.days_since_last") * DAY_US).cast("bigint")
    return of.select("target_match_id", a.alias("wins_a"), F.when(some, met - a).otherwise(F.lit(0).cast("bigint")).alias("wins_b"), F.when(some, F.col("as_of_us") - ago).alias("last_played_us"), F.array(*[F.lit(x) for x in UNCONVERTIBLE]).alias("unconvertible"))
