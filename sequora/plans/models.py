"""Queries on generated grids: models, planning and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import models as M
from .base import dna_sql, query


def _values(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def _rows_sql(rows) -> str:
    lit = lambda x: f"'{x}'" if isinstance(x, str) else repr(x)
    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


@query("drift_model", "SELECT CAST(c AS DOUBLE) AS celsius, CAST(y AS BIGINT) AS years, dry, round(exp(-5.21e-6 * pow(10.0, (c - 25) / 10.0) * (CASE WHEN dry THEN 0.01 ELSE 1.0 END) * y * 200), 9) AS survival FROM range(-20, 41, 10) t(c), range(1, 1002, 100) u(y), (VALUES (true), (false)) v(dry)")
def drift_model(spark, sf):
    c = spark.range(-20, 41, 10).select(F.col("id").cast("double").alias("celsius"))
    y = spark.range(1, 1002, 100).select(F.col("id").alias("years"))
    grid = c.crossJoin(y).crossJoin(_values(spark, [(True,), (False,)], "dry boolean"))
    return grid.withColumn("survival", F.round(M.drift_survival(M.drift_rate(F.col("celsius"), F.col("dry")), F.col("years"), F.lit(200)), 9))


_PRESETS = [(k, *v) for k, v in M.PRESETS.items()]


@query("density_grid", f"SELECT preset, inner_bytes, payload_bytes, payload_bytes > 0 AS valid, round(payload_bytes * 8 / nt / (1 + ratio), 6) AS density FROM (SELECT preset, nt, ratio, CAST((nt - 2 * primer) // 4 AS INT) AS inner_bytes, CAST(((nt - 2 * primer) // 4 - 6 - parity) - ((nt - 2 * primer) // 4 - 6 - parity) % 2 AS INT) AS payload_bytes FROM (VALUES {_rows_sql(_PRESETS)}) p(preset, nt, primer, parity, ratio))")
def density_grid(spark, sf):
    p = _values(spark, _PRESETS, "preset string, nt int, primer int, parity int, ratio double").withColumn("l", M.layout(F.col("nt"), F.col("primer"), F.col("parity")))
    return p.select("preset", "l.*", F.round(M.net_density(F.col("l.payload_bytes"), F.col("nt"), F.col("ratio")), 6).alias("density"))


_VENDORS = [(k, *v) for k, v in M.VENDORS.items()]


@query("order_cost", f"SELECT vendor, source, n_oligos, round(CAST(greatest(n_oligos * 200 * rate + setup, minimum) AS DOUBLE), 2) AS cost FROM (SELECT source, CAST(sum(ceil(4 * octet_length(encode(text)) / 200.0)) AS BIGINT) AS n_oligos FROM documents GROUP BY source), (VALUES {_rows_sql(_VENDORS)}) v(vendor, rate, setup, minimum, longest) WHERE longest >= 200")
def order_cost(spark, sf):
    n = F.ceil(4 * F.octet_length("text") / 200.0)
    s = spark.read.parquet(f"{sf}/documents.parquet").groupBy("source").agg(F.sum(n).cast("long").alias("n_oligos"))
    v = _values(spark, _VENDORS, "vendor string, rate double, setup double, minimum double, longest int").where("longest >= 200")
    return s.crossJoin(F.broadcast(v)).select("vendor", "source", "n_oligos", F.round(M.order_cost(F.col("n_oligos") * 200, F.col("rate"), F.col("setup"), F.col("minimum")), 2).alias("cost"))


@query("pool_plan", "SELECT source, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, CAST(ceil(sum(octet_length(encode(text))) / 40.0) AS BIGINT) AS strands, CAST(ceil(ceil(sum(octet_length(encode(text))) / 40.0) / 65535) AS BIGINT) AS shards FROM documents GROUP BY source")
def pool_plan(spark, sf):
    s = spark.read.parquet(f"{sf}/documents.parquet").groupBy("source").agg(F.sum(F.octet_length("text")).alias("bytes"))
    return s.withColumn("strands", F.ceil(F.col("bytes") / 40.0)).withColumn("shards", F.ceil(F.col("strands") / 65535))


@query("coverage_model", "SELECT CAST(c AS BIGINT) AS coverage, CAST(d AS BIGINT) AS dropout_pct, round((1 - d / 100.0) * (1 - exp(-CAST(c AS DOUBLE))), 9) AS chance FROM range(1, 31) t(c), range(0, 11, 5) u(d)")
def coverage_model(spark, sf):
    g = spark.range(1, 31).select(F.col("id").alias("coverage")).crossJoin(spark.range(0, 11, 5).select(F.col("id").alias("dropout_pct")))
    return g.withColumn("chance", F.round(M.recovery_chance(F.col("coverage"), F.col("dropout_pct") / 100.0), 9))


@query(
    "rsd_cdf",
    """WITH r AS (SELECT 0.1 * ln(1000 / 0.5) * sqrt(1000.0) AS r), d AS (SELECT CAST(d AS BIGINT) AS degree, CAST(d AS DOUBLE) AS x, r, floor(1000.0 / r) AS s FROM range(1, 1001) t(d), r),
    w AS (SELECT degree, CASE WHEN x = 1 THEN 0.001::DOUBLE ELSE 1 / (x * (x - 1)) END + CASE WHEN x < s THEN r / (x * 1000) WHEN x = s THEN r * ln(r / 0.5) / 1000 ELSE 0 END AS w FROM d)
    SELECT degree, round(w / sum(w) OVER (), 9) AS p, round(sum(w) OVER (ORDER BY degree) / sum(w) OVER (), 9) AS cdf FROM w""",
)
def rsd_cdf(spark, sf):
    return M.robust_soliton(spark, 1000).select("degree", F.round("p", 9).alias("p"), F.round("cdf", 9).alias("cdf"))


@query(
    "melting_points",
    f"""WITH nn AS (SELECT * FROM (VALUES {', '.join(f"('{d}', {h}, {s})" for d, (h, s) in M.NEIGHBOURS.items())}) AS t(d, h, s)),
    p AS (SELECT item_id, substr({dna_sql('text')}, 1, 24) AS primer FROM benchmark),
    e AS (SELECT item_id, primer, CAST(primer[1] IN ('G', 'C') AS INT) + CAST(primer[24] IN ('G', 'C') AS INT) AS gc,
      primer = reverse(translate(primer, 'ACGT', 'TGCA')) AS own FROM p WHERE length(primer) = 24),
    x AS (SELECT item_id, primer, gc, own, sum(CAST(h AS DOUBLE)) AS h, sum(CAST(s AS DOUBLE)) AS s
      FROM (SELECT *, unnest(range(1, 24)) AS k FROM e) JOIN nn ON d = substr(primer, k, 2) GROUP BY ALL)
    SELECT item_id, primer, round((h + 0.1 * gc + 2.3 * (2 - gc)) * 1000 / (s - 2.8 * gc + 4.1 * (2 - gc) + 1.987 * ln(CASE WHEN own THEN 0.25e-6 ELSE 0.25e-6 / 4 END))
      - 273.15 + 16.6 * log10(0.05), 4) AS celsius FROM x""",
)
def melting_points(spark, sf):
    """Nearest-neighbour melting point of the first 24 bases of each reference (its primer)."""
    from ..functions import sequence as S

    b = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", F.substring(S.bytes_to_dna("text"), 1, 24).alias("primer"))
    return b.where(F.length("primer") == 24).select("item_id", "primer", F.round(M.melting_nearest_neighbour(F.col("primer")), 4).alias("celsius"))
