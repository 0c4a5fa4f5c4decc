"""Times five jobs on the daily panel in one NumPy process and in Spark; prints one JSON line.

The panel is brand_day (730 training rows, a step of 30). Both read the same Parquet files, and their results are compared.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

import duckdb
import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ballastry.operators import backtest, kernels, strategies
from ballastry.plans.panels import SIZES, market

TRAIN, STEP = SIZES["brand_day"]


def numpy_jobs(sf_dir: str) -> tuple[dict[str, float], dict[str, dict]]:
    began = time.time()
    rows = duckdb.sql(
        f"""SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS d, avg(l_extendedprice / l_quantity) AS close
            FROM '{sf_dir}/lineitem.parquet' JOIN '{sf_dir}/part.parquet' ON l_partkey = p_partkey GROUP BY 1, 2"""
    ).df()
    px = rows.pivot(index="d", columns="symbol", values="close").sort_index()
    rets = px.to_numpy()[1:] / px.to_numpy()[:-1] - 1
    periods = (len(px) - TRAIN - STEP) // STEP
    took = {"panel": time.time() - began}
    began = time.time()
    windows = []
    for p in range(periods):
        x = rets[p * STEP : p * STEP + TRAIN]
        whole = ~np.isnan(x).any(axis=0)
        windows.append((whole, np.cov(x[:, whole].T)))
    took["covariances"] = time.time() - began
    out = {}
    for name, f in {
        "IVP": lambda c: (1 / np.diag(c)) / (1 / np.diag(c)).sum(),
        "HRP": lambda c: kernels.bisected(c, kernels.leaf_order(len(c), kernels.single_linkage(kernels.distances(c)))),
        "MVP": kernels.minimum_variance,
    }.items():
        began = time.time()
        weights = np.zeros((periods, rets.shape[1]))
        for p, (whole, c) in enumerate(windows):
            weights[p, whole] = f(c)
        took[name] = time.time() - began
        began = time.time()
        series = np.concatenate([np.nan_to_num(rets[p * STEP + TRAIN : p * STEP + TRAIN + STEP]) @ weights[p] for p in range(periods)])
        took[f"rolling_{name}"] = time.time() - began
        out[name] = {"weights": weights, "series": series}
    return took, out


def spark_jobs(spark: SparkSession, sf_dir: str) -> tuple[dict[str, float], dict[str, dict]]:
    began = time.time()
    m = market(spark, sf_dir, "brand_day")
    m.rets.count()
    took = {"panel": time.time() - began}
    began = time.time()
    m.cov.count()
    took["covariances"] = time.time() - began
    out = {}
    for name in ("IVP", "HRP", "MVP"):
        began = time.time()
        w = strategies.weights_of(m, [name]).persist()
        w.count()
        took[name] = time.time() - began
        began = time.time()
        series = backtest.rolling(m, w).toPandas().sort_values("t_idx")["ret"].to_numpy()
        took[f"rolling_{name}"] = time.time() - began
        began = time.time()
        backtest.carried(m, w).agg(F.max("cum")).collect()
        took[f"carry_{name}"] = time.time() - began
        out[name] = {"weights": w.toPandas().pivot(index="period", columns="symbol", values="weight").fillna(0).to_numpy(), "series": series}
    return took, out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.local.dir", folder).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    plain, want = numpy_jobs(sf_dir)
    market(spark, sf_dir, "type_month").rets.count()  # starts the session's code
    own, got = spark_jobs(spark, sf_dir)
    for name in want:
        assert np.allclose(want[name]["series"], got[name]["series"], atol=1e-7), name
    print(json.dumps({"numpy": {k: round(v, 3) for k, v in plain.items()}, "spark": {k: round(v, 3) for k, v in own.items()}, "cpus": int(cpus), "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
