"""Column expressions that several operators share. All are built-in expressions unless said otherwise."""

from __future__ import annotations

import difflib
import hashlib
import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000


def clamp(x: Column, low: float, high: float) -> Column:
    """``x`` within [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def sigmoid(z: Column) -> Column:
    """Logistic function that does not overflow for large absolute values."""
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def rate(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, null where the denominator is not positive: no data is not zero."""
    return F.when(denominator > 0, numerator.cast("double") / denominator)


def decay(days: Column, half_life: float) -> Column:
    """Weight that halves every ``half_life`` days; the future has weight 1."""
    return F.pow(F.lit(0.5), F.greatest(F.lit(0.0), days) / F.lit(half_life))


def short_hash(text: Column) -> Column:
    """First 16 hexadecimal digits of the SHA-256 of a text."""
    return F.substring(F.sha2(text, 256), 1, 16)


def iso_text(ts: Column) -> Column:
    """UTC instant as text with an explicit +00:00 offset; microseconds only where there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    return F.concat(whole, F.when(micros > 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise(F.lit("")), F.lit("+00:00"))


def _fold(text: str | None) -> str | None:
    if text is None:
        return None
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()
    return " ".join("".join(c if c.isalnum() else " " for c in plain).split()) or None


@F.pandas_udf(StringType())
def normalised_name(names: pd.Series) -> pd.Series:
    """Name without accents, case, punctuation and extra blanks; null if nothing is left. In Arrow batches."""
    return names.map(_fold)


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two texts (order matters); null if either is null. In Arrow batches."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def _canonical(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"))
    except ValueError:
        return None


@F.pandas_udf(StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """JSON with sorted keys and no blanks; null if it is not JSON. In Arrow batches."""
    return texts.map(_canonical)


@F.pandas_udf(StringType())
def payload_fingerprint(texts: pd.Series) -> pd.Series:
    """First 16 hexadecimal digits of the SHA-256 of the canonical JSON."""
    return texts.map(lambda t: None if (c := _canonical(t)) is None else hashlib.sha256(c.encode()).hexdigest()[:16])


def binary_round(x: Column, digits: int) -> Column:
    """A double rounded by its exact binary value, ties to even: 2.675 to two digits is 2.67. In Arrow batches."""

    @F.pandas_udf(DoubleType())
    def rounded(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None or v != v else round(v, digits) if abs(v) != float("inf") else v)

    return rounded(x.cast("double"))


def digests(ids: Column) -> dict[str, Column]:
    """Two 40-bit hashes of an id; their sums over a set bind it, in any order, and can be taken back."""
    return {f"d{k}": F.conv(F.substring(F.md5(ids.cast("string")), 1 + 10 * k, 10), 16, 10).cast("bigint") for k in (0, 1)}


def run_id(source: Column, provider: Column, started: Column) -> Column:
    """Name of an import run: hash of the source, the provider and when it started."""
    return short_hash(F.concat_ws("|", source, provider, iso_text(started)))


def is_semver(text: Column) -> Column:
    """Whether a text is three numbers joined by dots."""
    return F.coalesce(text.rlike(r"^\d+\.\d+\.\d+$"), F.lit(False))
