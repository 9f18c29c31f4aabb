"""A whole import as a stream: raw messages in, stored records, quarantine and conflicts out, batch by batch.

Each micro-batch is one set of joins: messages are mapped and validated, players resolved against the identities known so
far, and matches, quotes, rankings and competitions compared with what is stored. Tables are keyed, so a batch that runs
twice after a failure changes nothing the second time; the stream's checkpoint remembers which files are done.
"""

from __future__ import annotations

import os
import shutil
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from matchlake.functions.columns import normalised_name
from matchlake.operators import adapt, identity, ingest, validate
from matchlake.session import written
from matchlake.sources.store import KeyedTable
from matchlake.streaming.imports import raw_stream

_SETS = "array<struct<set_number:int,player_a_points:int,player_b_points:int>>"
TABLES = {
    "identities": "id string, normalized_name string, aliases array<string>, country string, birth_date date, external_ids array<struct<provider:string,provider_player_id:string>>",
    "players": "id string, name string, country string, provider string, provider_player_id string, ingested_at timestamp",
    "matches": f"id string, provider string, competition_id string, player_a string, player_b string, scheduled_us bigint, start_us bigint, done_us bigint, status string, best_of int, winner string, sets {_SETS}, ingested_at timestamp",
    "odds": "id string, match_id string, bookmaker string, selection string, decimal_odds double, captured_us bigint, provider string, market_id string",
    "rankings": "id string, player_id string, ranking int, ranking_points double, effective_at timestamp, provider string, ingested_at timestamp",
    "competitions": "id string, provider string, name string, country string, level string, format string, season string, indoor boolean, active_from timestamp, active_to timestamp, ingested_at timestamp",
    "quarantine": "id string, record_type string, provider string, provider_record_id string, reason string, detail string",
    "conflicts": "id string, record_type string, provider string, provider_record_id string, conflicting_field string",
}


class Store:
    """The tables of an import under one folder."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 16):
        self.tables = {n: KeyedTable(spark, f"{folder}/{n}", "id", schema, buckets) for n, schema in TABLES.items()}

    def __getitem__(self, name: str) -> KeyedTable:
        return self.tables[name]

    def fingerprint(self) -> str:
        """The number of rows of each kind of record."""
        return ",".join(f"{n}={self[n].count()}" for n in ("players", "matches", "odds", "rankings", "competitions"))


def _outcome(df: DataFrame, kind: str, outcome, reason=None, detail=None) -> DataFrame:
    text = lambda c: F.lit(None).cast("string") if c is None else c
    return df.select(F.lit(kind).alias("record_type"), F.col("provenance.provider").alias("provider"), F.col("provenance.provider_record_id").alias("provider_record_id"), F.monotonically_increasing_id().alias("row_id"), outcome.alias("outcome"), text(reason).alias("reason"), text(detail).alias("detail"))


def _players(rows: DataFrame, store: Store) -> tuple[DataFrame, DataFrame]:
    """(rows with internal_id, outcome, reason; new identities). Players new in one batch don't see each other's names."""
    asked = rows.select(
        F.concat_ws(":", "provenance.provider", "provenance.provider_record_id").alias("candidate_id"), normalised_name("name").alias("normalized_name"), "country", F.lit(None).cast("date").alias("birth_date"),
        F.col("provenance.provider").alias("external_provider"), F.col("provenance.provider_record_id").alias("external_player_id"),
    )
    found = identity.resolve(asked, store["identities"].read()).select("candidate_id", F.col("outcome").alias("__o"), "identity_id")
    named = rows.withColumn("candidate_id", F.concat_ws(":", "provenance.provider", "provenance.provider_record_id")).join(found, "candidate_id", "left")
    blank = F.length(F.trim(F.coalesce("name", F.lit("")))) == 0
    internal = F.when(F.col("__o") == "matched", F.col("identity_id")).when(F.col("__o") == "created", F.concat(F.lit("player:"), F.col("candidate_id")))
    held = store["players"].read().select(F.col("id").alias("__held"))
    named = named.withColumn("internal_id", F.when(~blank, internal)).join(held, F.col("internal_id") == F.col("__held"), "left")
    outcome = F.when(F.col("internal_id").isNull(), "quarantined").when(F.col("__held").isNotNull(), "merged_safe").otherwise("inserted")
    reason = F.when(blank, "missing_critical_field").when(F.col("internal_id").isNull(), "ambiguous_identity")
    named = named.withColumns({"outcome": outcome, "reason": reason})
    number = F.struct(F.col("provenance.provider").alias("provider"), F.col("provenance.provider_record_id").alias("provider_player_id"))
    new = named.where("__o = 'created' and internal_id is not null").select(F.col("internal_id").alias("id"), normalised_name("name").alias("normalized_name"), F.array().cast("array<string>").alias("aliases"), "country", F.lit(None).cast("date").alias("birth_date"), F.array(number).alias("external_ids"))
    # A name that was matched brings its number along, so that other records can refer to it.
    more = named.where("__o = 'matched'").select(F.col("internal_id").alias("id"), number.alias("n"))
    known = store["identities"].read()
    grown = known.join(more.groupBy("id").agg(F.collect_set("n").alias("__n")), "id")  # the numbers of one player
    grown = grown.withColumn("external_ids", F.array_union(F.coalesce("external_ids", F.array().cast(known.schema["external_ids"].dataType)), "__n")).drop("__n")
    return named, new.unionByName(grown)


def import_batch(raw: DataFrame, store: Store, registry: adapt.Registry, now_us: int | None = None, strict: bool = True) -> dict:
    """Import one batch of raw messages (as ``streaming.imports.RAW``) and return its report: counts by record type and
    outcome. Exact redeliveries within the batch are dropped only by their outcome, so they are counted."""
    raw = raw.persist()
    try:
        done: list[DataFrame] = []
        own = {t: adapt.adapt_all(raw, t, registry) for t in adapt.RECORD_TYPES}
        lost = adapt.unmapped(raw, registry.mappings()).withColumn("reason", F.lit("unmapped"))
        for refused in [lost, *[r for _, r in own.values()]]:
            done.append(refused.select(F.coalesce("record_type", F.lit("unknown")).alias("record_type"), "provider", "provider_record_id", F.col("delivery_id").alias("row_id"), F.lit("quarantined").alias("outcome"), F.lit("unsupported_payload").alias("reason"), F.col("reason").alias("detail")))

        players, identities = _players(own["player"][0].dropDuplicates(["external_player_id"]), store)
        players = players.persist()
        added = players.where("outcome = 'inserted'").select(F.col("internal_id").alias("id"), "name", "country", F.col("provenance.provider").alias("provider"), F.col("provenance.provider_record_id").alias("provider_player_id"), F.col("provenance.ingested_at").alias("ingested_at"))
        done.append(_outcome(players, "player", F.col("outcome"), F.col("reason")))
        store["identities"].upsert(identities)
        store["players"].upsert(added)
        listed = store["identities"].read()
        index = ingest.external_index(listed, raw.select("provider", F.lit(None).cast("string").alias("external_id")).limit(0))

        at = lambda df, **t: df.withColumns({n: F.unix_micros(c) for n, c in t.items()})
        rows = at(own["match"][0], scheduled_us="scheduled_at", start_us="actual_start_at", done_us="completed_at").withColumn("match_row_id", F.monotonically_increasing_id())
        matches = ingest.match_results(validate.match_issues(rows.transform(written), now_us), index, store["matches"].read(), strict).transform(written)
        quoted = at(own["odds"][0], captured_us="captured_at").withColumn("match_effective_us", F.lit(None).cast("bigint")).withColumn("odds_row_id", F.monotonically_increasing_id())
        odds = ingest.odds_results(validate.odds_issues(quoted.transform(written), now_us), index, store["odds"].read(), strict).transform(written)
        both = ingest.results(matches, odds).withColumn("record_type", F.regexp_replace("table_name", "^imported_", "")).select("record_type", "provider", "provider_record_id", "row_id", "outcome", "reason", "detail")
        ranked = ingest._resolved(own["ranking"][0], index, {"player_id": "player_external_id"}).withColumn("id", ingest._record_id())
        gone = F.col("player_id").isNull() | F.col("ranking").isNull() | F.col("effective_at").isNull()
        kept = {}
        for kind, table, part, bad in (("ranking", "rankings", ranked, gone), ("competition", "competitions", own["competition"][0].withColumn("id", ingest._record_id()), F.lit(False))):
            held = store[table].read().select(F.col("id").alias("__held"))
            each = part.join(held, F.col("id") == F.col("__held"), "left").transform(written)
            first = each.where(~bad & F.col("__held").isNull()).dropDuplicates(["id"])
            kept[table] = first.withColumns({"provider": F.col("provenance.provider"), "ingested_at": F.col("provenance.ingested_at")})
            done.append(_outcome(each, kind, F.when(bad, "quarantined").when(F.col("__held").isNotNull(), "skipped_idempotent").otherwise("inserted"), F.when(bad, "missing_critical_field")))
        all_ = written(reduce(DataFrame.unionByName, [both, *done]))
        better = matches.where("outcome in ('inserted', 'merged_safe')").withColumns({"id": F.col("internal_id"), "provider": F.col("provenance.provider"), "player_a": F.col("a_id"), "player_b": F.col("b_id"), "ingested_at": F.col("provenance.ingested_at")})
        better = better.groupBy("id").agg(F.max_by(F.struct(*[c for c in store["matches"].read().columns if c != "id"]), F.struct(F.col("outcome") == "merged_safe", "match_row_id")).alias("m")).select("id", "m.*")
        store["matches"].upsert(better)
        store["odds"].upsert(odds.where("outcome = 'inserted'").withColumns({"id": F.col("internal_id"), "provider": F.col("provenance.provider"), "match_id": F.concat_ws(":", "provenance.provider", "provider_match_id")}))
        for table, part in kept.items():
            store[table].upsert(part)
        name = lambda word: F.concat_ws(":", F.lit(word), "record_type", "provider", F.coalesce("provider_record_id", F.col("row_id").cast("string")))
        store["quarantine"].upsert(all_.where("outcome = 'quarantined'").withColumn("id", name("quarantine")))
        store["conflicts"].upsert(all_.where("outcome = 'rejected_conflict'").withColumn("id", name("conflict")).withColumnRenamed("reason", "conflicting_field"))
        return {(r["record_type"], r["outcome"]): r["n"] for r in all_.groupBy("record_type", "outcome").agg(F.count("*").alias("n")).collect()}  # a row a kind
    finally:
        raw.unpersist()


class CheckpointVersionError(ValueError):
    """A checkpoint was made by another version of the import."""


def _check_version(checkpoint: str, version: str) -> None:
    """Raise if the checkpoint has another version than ``version``; a new one gets it."""
    os.makedirs(checkpoint, exist_ok=True)
    path = f"{checkpoint}/import.version"
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            if (found := f.read().strip()) != version:
                raise CheckpointVersionError(f"{checkpoint}: version {found}, not {version}")
    else:
        with open(path, "w", encoding="utf-8") as f:
            f.write(version)


def import_stream(
    spark: SparkSession, folder: str, store: Store, checkpoint: str, registry: adapt.Registry, now_us: int | None = None, files_per_batch: int = 1, version: str = "1.0.0", every: str | None = None
) -> list[dict] | StreamingQuery:
    """Import what is new in ``folder`` and stop; returns the report of each batch. With ``every``, such as "1 minute", it goes
    on looking for new files that often and returns the running query. ``checkpoint`` is a folder of a local or mounted file
    system; one of another ``version`` raises."""
    _check_version(checkpoint, version)
    reports: list[dict] = []

    def run(batch: DataFrame, batch_id: int) -> None:
        reports.append({"batch_id": batch_id, "read": batch.count(), "outcomes": import_batch(batch, store, registry, now_us)})

    trigger = {"processingTime": every} if every else {"availableNow": True}
    query = raw_stream(spark, folder, files_per_batch).writeStream.foreachBatch(run).option("checkpointLocation", f"{checkpoint}/stream").trigger(**trigger).start()
    if every:
        return query
    query.awaitTermination()
    return reports


def reset(checkpoint: str) -> None:
    """Forget what was imported; the tables stay, so an import from the start only skips what they have."""
    shutil.rmtree(checkpoint, ignore_errors=True)
