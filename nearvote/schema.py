"""Types and fixed values of the scoring engine."""

from __future__ import annotations

#: Normalisation constants.
MAX_AMOUNT, MAX_INSTALLMENTS, AMOUNT_VS_AVG_RATIO, MAX_MINUTES = 10000.0, 12.0, 10.0, 1440.0
MAX_KM, MAX_TX_COUNT_24H, MAX_MERCHANT_AVG_AMOUNT = 1000.0, 20.0, 10000.0
#: Risk by merchant category; others have the default.
MCC_RISK = {"5411": 0.15, "5812": 0.30, "5912": 0.20, "5944": 0.45, "7801": 0.80, "7802": 0.75, "7995": 0.85, "4511": 0.35, "5311": 0.25, "5999": 0.50}
MCC_DEFAULT = 0.5
#: Search.
DIMS, TOP, FAST_PROBES, EXTRA_PROBES, DECLINE_AT = 14, 5, 2, 32, 0.6
NO_DISTANCE = 1 << 62
SENTINEL, SCALE = -32768, 32767
#: A fifth distance beyond its count's threshold escalates; 0: never by distance.
THRESHOLDS = {0: 57085402, 1: 34361598, 2: 0, 3: 0, 4: 0, 5: 52924841}
AMBIGUOUS = (2, 3, 4)
#: Training.
CLUSTERS, ITERATIONS, SAMPLE, REFINES, SEED = 4096, 30, 1_000_000, 3, 42

PAYLOAD = (
    "id string, transaction struct<amount: double, installments: bigint, requested_at: string>, "
    "customer struct<avg_amount: double, tx_count_24h: bigint, known_merchants: array<string>>, "
    "merchant struct<id: string, mcc: string, avg_amount: double>, "
    "terminal struct<is_online: boolean, card_present: boolean, km_from_home: double>, "
    "last_transaction struct<timestamp: string, km_from_current: double>"
)
PAYLOAD_FIELDS = ("id", "transaction", "customer", "merchant", "terminal", "last_transaction")
REFERENCE = "vector array<double>, label string"
