"""Closed-form models: densities, drift, melting, pools and costs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unified nearest-neighbour parameters (SantaLucia 1998), kcal/mol and cal/mol/K, by 5'->3' dimer.
NEIGHBOURS = {
    "AA": (-7.9, -22.2), "TT": (-7.9, -22.2), "AT": (-7.2, -20.4), "TA": (-7.2, -21.3),
    "CA": (-8.5, -22.7), "TG": (-8.5, -22.7), "GT": (-8.4, -22.4), "AC": (-8.4, -22.4),
    "CT": (-7.8, -21.0), "AG": (-7.8, -21.0), "GA": (-8.2, -22.2), "TC": (-8.2, -22.2),
    "CG": (-10.6, -27.2), "GC": (-9.8, -24.4), "GG": (-8.0, -19.9), "CC": (-8.0, -19.9),
}


def melting_nearest_neighbour(c: Column, strand: float = 0.25e-6, sodium: float = 0.05) -> Column:
    """Celsius melting point from nearest-neighbour sums, with a 16.6 log10[Na] shift."""
    dimers = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: c.substr(i, F.lit(2)))

    def total(which: int) -> Column:
        pick = lambda d: reduce(lambda e, k: F.when(d == k, NEIGHBOURS[k][which]).otherwise(e), NEIGHBOURS, F.lit(0.0))
        return F.aggregate(dimers, F.lit(0.0), lambda a, d: a + pick(d))

    # initiation at either end: (0.1, -2.8) for G or C, (2.3, 4.1) for A or T
    ends = [F.substring(c, 1, 1).isin("G", "C"), F.substring(c, -1, 1).isin("G", "C")]
    h = total(0) + sum(F.when(e, 0.1).otherwise(2.3) for e in ends)
    s = total(1) + sum(F.when(e, -2.8).otherwise(4.1) for e in ends)
    same = c == F.reverse(F.translate(c, "ACGT", "TGCA"))
    share = F.when(same, strand).otherwise(strand / 4)
    return F.when(F.length(c) < 2, 0.0).otherwise(h * 1000 / (s + 1.987 * F.log(share)) - 273.15 + 16.6 * F.log10(F.lit(sodium)))


def drift_rate(celsius: Column, dry: Column) -> Column:
    """Mutations a base and year: doubling-like rise of ten per ten degrees, a hundredth when dry."""
    return F.lit(5.21e-6) * F.pow(F.lit(10.0), (celsius - 25) / 10) * F.when(dry, 0.01).otherwise(1.0)


def drift_survival(rate: Column, years: Column, bases: Column) -> Column:
    """Share of strands of ``bases`` without a change after ``years``."""
    return F.exp(-rate * years * bases)


def net_density(payload_bytes: Column, oligo_nt: Column, outer_ratio: Column) -> Column:
    """Payload bits a base after the outer code's share."""
    return payload_bytes * 8 / oligo_nt / (1 + outer_ratio)


def order_cost(total_nt: Column, per_nt: Column, setup: Column, minimum: Column) -> Column:
    return F.greatest(total_nt * per_nt + setup, minimum)


def recovery_chance(coverage: Column, dropout: Column) -> Column:
    """Chance that a strand is read at least once under Poisson coverage."""
    return (1 - dropout) * (1 - F.exp(-coverage))


def robust_soliton(spark, k: int, c: float = 0.1, delta: float = 0.5):
    """(degree, p, cdf) of the robust soliton distribution."""
    from pyspark.sql import Window

    r = F.lit(c) * F.log(F.lit(k / delta)) * F.sqrt(F.lit(float(k)))
    spike = F.floor(F.lit(float(k)) / r)
    d = F.col("degree").cast("double")
    ideal = F.when(d == 1, 1.0 / k).otherwise(1 / (d * (d - 1)))
    extra = F.when(d < spike, r / (d * k)).when(d == spike, r * F.log(r / delta) / k).otherwise(0.0)
    rows = spark.range(1, k + 1).select(F.col("id").alias("degree")).withColumn("w", ideal + extra)
    total = F.sum("w").over(Window.partitionBy())
    upto = F.sum("w").over(Window.orderBy("degree").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.select("degree", (F.col("w") / total).alias("p"), (upto / total).alias("cdf"))


#: Fixed values of order planning, by vendor: price a base, setup fee, least order, longest oligo.
VENDORS = {"idt": (0.10, 25.0, 50.0, 230), "twist": (0.07, 50.0, 100.0, 300), "elegen": (0.05, 75.0, 200.0, 300)}

#: Fixed values of the presets: oligo nt, primer nt, inner parity bytes, outer ratio.
PRESETS = {
    "default": (300, 12, 4, 0.1), "nanopore": (300, 12, 10, 0.5), "pacbio": (300, 12, 8, 0.4), "ultimate-density": (500, 12, 8, 0.05),
    "ultimate-low-coverage": (500, 12, 10, 0.10), "ultimate-nanopore": (500, 12, 12, 0.4), "v55-density": (700, 12, 8, 0.03),
    "v55-omni": (500, 12, 6, 0.08), "v59-fast-encode": (300, 12, 4, 0.1), "v59-hd-fast": (700, 12, 4, 0.03), "v61-arithmetic": (700, 12, 8, 0.03),
    "v63-hd": (1100, 12, 4, 0.02), "v63-maxdensity": (1500, 12, 4, 0.02),
}


def layout(oligo_nt: Column, primer_nt: Column, parity: Column) -> Column:
    """Plain byte layout: whole bytes between primers, less address, parity and checksum, made even."""
    inner = F.floor((oligo_nt - 2 * primer_nt) / 4)
    payload = inner - 4 - parity - 2
    even = (payload - payload % 2).cast("int")
    return F.struct(inner.cast("int").alias("inner_bytes"), even.alias("payload_bytes"), (even > 0).alias("valid"))
