from datetime import datetime, timedelta

GOLD = "txn_id string, source string, amount double, vendor string, vendor_id string, date timestamp"


def at(day: float) -> datetime:
    return datetime(2025, 1, 1) + timedelta(days=day)


def gold(spark, rows, source="credit_card"):
    """rows: (txn_id, amount, vendor, vendor_id, day or None)"""
    data = [(i, source, a, v, k, None if d is None else at(d)) for i, a, v, k, d in rows]
    return spark.createDataFrame(data, GOLD)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
