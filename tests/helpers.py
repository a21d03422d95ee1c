import datetime as dt

from pyspark.sql import functions as F

DAY0 = dt.datetime(2020, 1, 1)


def days(n):
    return [DAY0 + dt.timedelta(days=i) for i in range(n)]


def panel(spark, prices, **columns):
    """Panel from ``{symbol: [price, ...]}``; extra columns per symbol alike."""
    rows = []
    for s, px in prices.items():
        for i, (t, p) in enumerate(zip(days(len(px)), px)):
            prev = px[i - 1] if i else None
            ret = p / prev - 1 if prev and p is not None else None
            p, prev = (None if v is None else float(v) for v in (p, prev))
            extra = [columns[c][s][i] for c in columns]
            rows.append((s, t, i, p, p, ret, True, *extra))
    names = "symbol string, ts timestamp_ntz, pos long, close double, tr double, ret double, in_universe boolean"
    names += "".join(f", {c} double" for c in columns)
    return spark.createDataFrame(rows, names).withColumn("run_id", F.lit("run"))


def daily(spark, returns, value="net"):
    rows = [("run", t, r) for t, r in returns]
    return spark.createDataFrame(rows, f"run_id string, ts timestamp_ntz, {value} double")
