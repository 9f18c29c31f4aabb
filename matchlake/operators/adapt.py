"""Raw provider messages mapped to import rows by a declared mapping of field names.

A mapping is data: the projection is generated from it, and every value is taken out of the JSON by a built-in
expression. What can't be read becomes null, never an error; what a policy rejects goes to a separate frame.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.functions.columns import payload_fingerprint

STATUSES = ("scheduled", "live", "finished", "retired", "cancelled")
RECORD_TYPES = ("player", "match", "odds", "competition", "ranking")
#: Type of each canonical field; what is not here is a text.
TYPES = {"best_of": "int", "ranking": "int", "ranking_hint": "int", "decimal_odds": "double", "ranking_points": "double", "indoor": "boolean"}
TIMES = ("scheduled_at", "actual_start_at", "completed_at", "captured_at", "effective_at", "active_from", "active_to")


@dataclass(frozen=True)
class ProviderMapping:
    """canonical field -> key in the provider's payload, for each record type, and the provider's status words."""

    provider: str
    fields: Mapping[str, Mapping[str, str]]
    statuses: Mapping[str, str] = field(default_factory=dict)
    unknown_status: str = "warn"
    sets_key: str = "sets"
    set_keys: tuple[str, str, str] = ("set_number", "a", "b")
    version: str = "1"

    def __post_init__(self) -> None:
        if bad := set(self.statuses.values()) - set(STATUSES):
            raise ValueError(f"not canonical statuses: {sorted(bad)}")
        if bad := set(self.fields) - set(RECORD_TYPES):
            raise ValueError(f"unknown record types: {sorted(bad)}")
        if self.unknown_status not in ("warn", "reject"):
            raise ValueError("unknown_status is warn or reject")


def instant(text: Column) -> Column:
    """ISO-8601 text with a zone as a timestamp, else null."""
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.when(zoned, F.try_to_timestamp(text))


def _value(payload: Column, key: str, name: str) -> Column:
    text = F.get_json_object(payload, f"$['{key}']")
    if name in TIMES:
        return instant(text)
    return F.expr("null").cast(TYPES.get(name, "string")) if not key else (text.try_cast(TYPES[name]) if name in TYPES else text)


def map_status(raw: Column, mapping: ProviderMapping) -> Column:
    """Canonical status of a provider's word (case counts), null if it has none."""
    if not mapping.statuses:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in mapping.statuses.items() for x in kv]), raw)


class UnknownProviderError(KeyError):
    """No mapping is registered for a provider."""


class Registry:
    """Mappings by provider."""

    def __init__(self, *mappings: ProviderMapping):
        self._of = {m.provider: m for m in mappings}

    def register(self, mapping: ProviderMapping) -> None:
        self._of[mapping.provider] = mapping

    def get(self, provider: str) -> ProviderMapping:
        if provider not in self._of:
            raise UnknownProviderError(f"no mapping for provider {provider!r}")
        return self._of[provider]

    def providers(self) -> list[str]:
        return sorted(self._of)

    def mappings(self) -> dict[str, ProviderMapping]:
        return dict(self._of)


def adapt_all(raw: DataFrame, record_type: str, registry: Registry) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected) of one record type of all registered providers; providers with equal mappings share one scan."""
    alike: dict[str, list[str]] = {}
    for name in registry.providers():
        m = registry.get(name)
        if record_type in m.fields:
            alike.setdefault(repr(replace(m, provider="")), []).append(name)
    done = [adapt(raw, record_type, registry.get(names[0]), names) for names in alike.values()]
    if not done:
        raise UnknownProviderError(f"no mapping has {record_type}")
    return tuple(reduce(DataFrame.unionByName, side) for side in zip(*done))


def adapt(raw: DataFrame, record_type: str, mapping: ProviderMapping, providers: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected) of one record type of the mapping's provider, or of ``providers`` if given.

    ``raw``: provider, provider_record_id, record_type, payload (JSON text), source_batch_id, source_timestamp,
    fetched_at. rows: provenance and the mapped fields; fields without a key are null. rejected: the raw columns
    with a reason: payload that is no JSON object, or an unknown status under the policy "reject".
    """
    if record_type not in mapping.fields:
        raise ValueError(f"the mapping of {mapping.provider} has no {record_type}")
    own = raw.where(F.col("provider").isin(*(providers or [mapping.provider])) & (F.col("record_type") == record_type))
    payload = F.col("payload")
    readable = F.coalesce(F.trim(payload).startswith("{") & F.expr("try_parse_json(payload)").isNotNull(), F.lit(False))
    names = mapping.fields[record_type]
    columns = {n: _value(payload, k, n) for n, k in names.items() if n != "status"}
    warnings = F.array().cast("array<string>")
    reason = F.when(~readable, "payload is not a JSON object")
    if record_type == "match":
        word = F.get_json_object(payload, f"$['{names.get('status', 'status')}']")
        status = map_status(word, mapping)
        unknown = word.isNotNull() & status.isNull()
        columns |= {"status_raw": word, "status": status}
        warnings = F.when(unknown, F.array(F.concat(F.lit("unknown status "), word))).otherwise(warnings)
        if mapping.unknown_status == "reject":
            reason = F.coalesce(reason, F.when(unknown, F.concat(F.lit("unknown status "), word)))
        n, a, b = mapping.set_keys
        items = F.from_json(F.get_json_object(payload, f"$['{mapping.sets_key}']"), "array<string>")
        read = lambda s: F.struct(*[F.get_json_object(s, f"$['{k}']").try_cast("int").alias(x) for k, x in ((n, "set_number"), (a, "player_a_points"), (b, "player_b_points"))])
        objects = F.filter(items, lambda s: F.trim(s).startswith("{"))
        columns["sets"] = F.coalesce(F.transform(objects, read), F.array().cast("array<struct<set_number:int,player_a_points:int,player_b_points:int>>"))
        odd = F.coalesce(F.size(items) - F.size(objects), F.lit(0))
        warnings = F.when(odd > 0, F.array_append(warnings, F.concat(odd.cast("string"), F.lit(" set entries are no objects")))).otherwise(warnings)
    if record_type == "player":
        columns["external_player_id"] = F.col("provider_record_id")
    provenance = F.struct(
        "provider", "provider_record_id", "source_batch_id", "source_timestamp", F.col("fetched_at").alias("ingested_at"),
        payload_fingerprint(payload).alias("raw_fingerprint"), F.lit(mapping.version).alias("mapping_version"), warnings.alias("warnings"), F.lit(None).cast("string").alias("raw_payload_ref"),
    ).alias("provenance")
    marked = own.withColumn("__reason", reason)
    rows = marked.where(F.col("__reason").isNull()).select(provenance, *[c.alias(n) for n, c in columns.items()])
    return rows, marked.where(F.col("__reason").isNotNull()).withColumnRenamed("__reason", "reason")


def unmapped(raw: DataFrame, mappings: Mapping[str, ProviderMapping]) -> DataFrame:
    """The messages that no mapping covers: unknown provider or record type."""
    known = [F.lit(f"{p}\u0000{t}") for p, m in mappings.items() for t in m.fields]
    return raw.where(~F.coalesce(F.concat_ws("\u0000", "provider", "record_type").isin(*known) if known else F.lit(False), F.lit(False)))
