import json
import math

import pytest
from pyspark.sql import functions as F

from nearvote import schema as S
from nearvote.functions import features
from nearvote.functions.vectors import bool_to_int8, box_bound, clamp, quantize, squared_l2
from nearvote.operators.decision import decode

BASE = {
    "id": "t1", "transaction": {"amount": 41.12, "installments": 2, "requested_at": "2026-03-11T18:45:53Z"},
    "customer": {"avg_amount": 82.24, "tx_count_24h": 3, "known_merchants": ["m1", "m2"]},
    "merchant": {"id": "m1", "mcc": "5411", "avg_amount": 60.25}, "terminal": {"is_online": False, "card_present": True, "km_from_home": 29.23}, "last_transaction": None,
}


def vector(spark, **changes):
    p = json.loads(json.dumps(BASE))
    for path, value in changes.items():
        *up, last = path.split("__")
        at = p
        for x in up:
            at = at[x]
        at[last] = value
    rows = decode(spark.createDataFrame([("q", json.dumps(p))], "q_id string, body string"))
    return features.vectorize(rows).select("features").first()[0]


@pytest.mark.parametrize(
    ("dim", "changes", "want"),
    [
        (0, {"transaction__amount": 5000.0}, 0.5), (0, {"transaction__amount": 15000.0}, 1.0), (0, {}, 0.004112), (1, {"transaction__installments": 6}, 0.5), (1, {"transaction__installments": 24}, 1.0),
        (2, {"transaction__amount": 1000.0, "customer__avg_amount": 200.0}, 0.5), (2, {"customer__avg_amount": 0.0}, 1.0), (2, {"customer__avg_amount": 0.0, "transaction__amount": 0.0}, 0.0),
        (3, {"transaction__requested_at": "2026-03-11T12:00:00Z"}, 12 / 23), (3, {"transaction__requested_at": "2026-03-11T23:30:00+09:00"}, 1.0),
        (4, {"transaction__requested_at": "2026-03-09T10:00:00Z"}, 0.0), (4, {"transaction__requested_at": "2026-03-15T10:00:00Z"}, 1.0),
        (5, {}, -1.0), (6, {}, -1.0), (5, {"last_transaction": {"timestamp": "2026-03-11T17:45:53Z", "km_from_current": 500.0}}, 60 / 1440),
        (5, {"last_transaction": {"timestamp": "2026-03-11T19:45:53Z", "km_from_current": 500.0}}, 0.0), (6, {"last_transaction": {"timestamp": "2026-03-11T17:45:53Z", "km_from_current": 500.0}}, 0.5),
        (7, {"terminal__km_from_home": 500.0}, 0.5), (8, {"customer__tx_count_24h": 25}, 1.0), (9, {"terminal__is_online": True}, 1.0), (10, {}, 1.0),
        (11, {}, 0.0), (11, {"merchant__id": "m9"}, 1.0), (11, {"customer__known_merchants": []}, 1.0), (12, {}, 0.15), (12, {"merchant__mcc": "9999"}, 0.5), (13, {"merchant__avg_amount": 5000.0}, 0.5),
    ],
)
def test_dimension(spark, dim, changes, want):
    assert vector(spark, **changes)[dim] == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("stamp", ["", "nonsense", "2026-03-11 18:45:53", "2026-03-11T18:45:53", "2026-02-30T18:45:53Z", "2026-03-11T25:00:00Z"])
def test_bad_timestamps(spark, stamp):
    assert vector(spark, transaction__requested_at=stamp) is None
    assert vector(spark, last_transaction={"timestamp": stamp, "km_from_current": 1.0}) is None


def test_quantize(spark):
    cases = {0.0: 0, 0.5: 16384, 1.0: 32767, 0.0041: 134, 1.5: 32767, -1.0: -32768, -0.001: -32768, 0.75: 24575, 0.25: 8192, math.nan: 0}
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "x double, want int").select(quantize(F.col("x")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in rows)


def test_vector_expressions(spark):
    a, b = F.array(*map(F.lit, (1, 2, 3))), F.array(*map(F.lit, (3, 2, 1)))
    low, high = F.array(*map(F.lit, (0, 0, 0))), F.array(*map(F.lit, (10, 10, 10)))
    far = F.array(*map(F.lit, (100, 100, 0)))
    null, zero = F.array(*(F.lit(S.SENTINEL).cast("smallint") for _ in range(2))), F.array(*(F.lit(0).cast("smallint") for _ in range(2)))
    row = spark.range(1).select(squared_l2(a, b, 3), squared_l2(null, zero, 2), box_bound(a, low, high, 3), box_bound(far, low, high, 3), clamp(F.lit(float("nan"))), clamp(F.lit(2.0)), bool_to_int8(F.lit(True))).first()
    assert row[0] == 8 and row[1] == 2 * 32768**2 and row[2] == 0 and row[3] == 2 * 90**2 and math.isnan(row[4]) and row[5] == 1.0 and row[6] == 1
