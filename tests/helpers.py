from datetime import datetime, timedelta

import numpy as np

START = datetime(2024, 3, 1)


def at(minutes: float) -> datetime:
    return START + timedelta(seconds=round(minutes * 60, 6))


def readings(spark, rows):
    """rows: (device, minutes, temp, rh, pressure, soil)"""
    return spark.createDataFrame(
        [(d, at(m), float(t), float(h), float(p), float(s)) for d, m, t, h, p, s in rows],
        "device_id string, ts timestamp, temp_c double, rh_pct double, pressure_hpa double, soil_moist_pct double",
    )


def random_readings(spark, n=400, hot=0.6, seed=1, span_minutes=3000):
    """One device holds most rows; gaps are uneven."""
    rng = np.random.default_rng(seed)
    minutes = np.unique(np.round(rng.uniform(0, span_minutes, n) ** 1.0, 3))
    device = np.where(rng.uniform(size=len(minutes)) < hot, "hot", np.where(rng.uniform(size=len(minutes)) < 0.5, "a", "b"))
    return readings(
        spark,
        [
            (str(d), float(m), *np.round(rng.normal([25, 60, 1005, 35], [3, 10, 5, 10]), 2).tolist())
            for d, m in zip(device, minutes)
        ],
    )
