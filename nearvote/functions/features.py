"""Payloads to feature vectors: one projection of 14 expressions, no Python."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearvote import schema as S
from nearvote.functions.vectors import clamp, quantize

#: Date and time with T, and a zone; casts alone would accept more.
RFC3339 = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d([.,]\d+)?(Z|[+-]\d\d:\d\d)$"


def instant(text: Column) -> Column:
    """A point in time, or null where the text is not RFC 3339."""
    return F.when(text.rlike(RFC3339), F.try_to_timestamp(F.regexp_replace(text, ",", ".")))


def wall_clock(text: Column) -> Column:
    """Local date and time in the text's own offset."""
    return F.when(text.rlike(RFC3339), F.substring(text, 1, 19).try_cast("timestamp_ntz"))


def _field(path: str, default) -> Column:
    return F.coalesce(F.col(path), F.lit(default))


def feature_columns() -> list[Column]:
    amount, requested = _field("transaction.amount", 0.0), F.col("transaction.requested_at")
    average, clock = _field("customer.avg_amount", 0.0), wall_clock(requested)
    ratio = F.when(average == 0, F.when(amount > 0, 1.0).otherwise(0.0)).otherwise(clamp(amount / F.nullif(average, F.lit(0.0)) / S.AMOUNT_VS_AVG_RATIO))
    none = F.col("last_transaction").isNull()
    minutes = (F.unix_micros(instant(requested)) - F.unix_micros(instant(F.col("last_transaction.timestamp")))) / 6e7
    known = F.coalesce(F.array_contains("customer.known_merchants", _field("merchant.id", "")), F.lit(False))
    risks = F.create_map(*map(F.lit, chain.from_iterable(S.MCC_RISK.items())))
    flag = lambda path: _field(path, False).cast("int").cast("double")
    return [
        clamp(amount / S.MAX_AMOUNT),
        clamp(_field("transaction.installments", 0) / S.MAX_INSTALLMENTS),
        ratio,
        F.hour(clock) / 23.0,
        F.weekday(clock) / 6.0,
        F.when(none, -1.0).otherwise(clamp(minutes / S.MAX_MINUTES)),
        F.when(none, -1.0).otherwise(clamp(_field("last_transaction.km_from_current", 0.0) / S.MAX_KM)),
        clamp(_field("terminal.km_from_home", 0.0) / S.MAX_KM),
        clamp(_field("customer.tx_count_24h", 0) / S.MAX_TX_COUNT_24H),
        flag("terminal.is_online"),
        flag("terminal.card_present"),
        F.when(known, 0.0).otherwise(1.0),
        F.coalesce(F.try_element_at(risks, _field("merchant.mcc", "")), F.lit(S.MCC_DEFAULT)),
        clamp(_field("merchant.avg_amount", 0.0) / S.MAX_MERCHANT_AVG_AMOUNT),
    ]


def parses() -> Column:
    """The timestamps that a payload needs are there and valid."""
    last = F.col("last_transaction").isNull() | instant(F.col("last_transaction.timestamp")).isNotNull()
    return F.coalesce(instant(F.col("transaction.requested_at")).isNotNull() & last, F.lit(False))


def vectorize(payloads: DataFrame) -> DataFrame:
    """payloads with `features`, an array of 14 doubles; null where timestamps do not parse."""
    return payloads.withColumn("features", F.when(parses(), F.array(*feature_columns())))


def vectorize_int16(payloads: DataFrame) -> DataFrame:
    """payloads with `v`, the quantised features."""
    return vectorize(payloads).withColumn("v", F.transform("features", quantize)).drop("features")
