"""Queries on reads with insertions and deletions, and on signals."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import codecs as C
from ..operators import consensus as K
from ..operators.bases import dna
from ..session import table
from .base import dna_sql, query


def noisy_reads(spark, sf, channel: str, coverage: int, nt: int = 96):
    """(strand, read, truth, sequence): seeded reads of every strand of every reference."""
    sub, ins, dele, _, _ = C.CHANNELS[channel]
    s = table(spark, sf, "benchmark").select("item_id", F.posexplode(S.chunks(S.bytes_to_dna("text"), nt)).alias("i", "truth"))
    rows = s.select((F.col("item_id") * 10000 + F.col("i")).alias("strand"), "truth", F.explode(F.sequence(F.lit(1), F.lit(coverage))).alias("read"))

    @F.pandas_udf("string")
    def make(strand: pd.Series, read: pd.Series, truth: pd.Series) -> pd.Series:
        return pd.Series([C.simulate(t, int(a) * 1009 + int(b), sub, ins, dele) for a, b, t in zip(strand, read, truth, strict=True)])

    return rows.withColumn("sequence", make("strand", "read", "truth"))


@query("consensus_star", f"SELECT item_id * 10000 + i AS strand, true AS ok FROM (SELECT item_id, unnest(range(len(c))) AS i FROM (SELECT item_id, regexp_extract_all(dna, '.{{1,96}}') AS c FROM (SELECT item_id, {dna_sql('text')} AS dna FROM benchmark)))")
def consensus_star(spark, sf):
    """Light noise with insertions and deletions: every strand comes back from nine reads."""
    r = noisy_reads(spark, sf, "illumina", 9)
    found = K.cluster_consensus(r, "strand", "read", "sequence")
    truth = r.where("read = 1").select("strand", "truth")
    return found.join(truth, "strand").select("strand", (F.col("consensus") == F.col("truth")).alias("ok"))


@query("consensus_nanopore")
def consensus_nanopore(spark, sf):
    """Share of strands that star consensus restores from heavy noise, by coverage."""
    parts = None
    for n in (5, 15):
        r = noisy_reads(spark, sf, "nanopore", n)
        found = K.cluster_consensus(r, "strand", "read", "sequence").join(r.where("read = 1").select("strand", "truth"), "strand")
        one = found.agg(F.lit(n).alias("coverage"), F.avg((F.col("consensus") == F.col("truth")).cast("int")).alias("exact"), F.avg("confidence").alias("confidence"))
        parts = one if parts is None else parts.unionByName(one)
    return parts


@query("edit_rates")
def edit_rates(spark, sf):
    """Aligned error rates of each channel's reads: what the channel was set to comes back."""
    schema = "channel string, matches long, substitutions long, insertions long, deletions long"
    parts = None
    for channel in C.CHANNELS:
        r = noisy_reads(spark, sf, channel, 2).select("truth", "sequence")

        def run(batches, channel=channel):
            for b in batches:
                e = K.edit_profile(list(zip(b["truth"], b["sequence"], strict=True)))
                yield pd.DataFrame([(channel, e["match"], e["substitution"], e["insertion"], e["deletion"])], columns=["channel", "matches", "substitutions", "insertions", "deletions"])

        one = r.mapInPandas(run, schema)
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy("channel").agg(*[F.sum(c).alias(c) for c in ("matches", "substitutions", "insertions", "deletions")])


@query("read_until")
def read_until(spark, sf):
    """The reference whose header signal is nearest to each conversation's first read; far ones are ejected."""
    heads = table(spark, sf, "benchmark").select("item_id", F.substring(dna("text"), 1, 40).alias("head"))
    known = {r["item_id"]: r["head"] for r in heads.collect()}  # a panel of targets, broadcast with the function

    @F.pandas_udf("struct<item_id:long,distance:double>")
    def nearest(head: pd.Series) -> pd.DataFrame:
        keys, distances = K.nearest_signals(list(head), known)
        return pd.DataFrame({"item_id": keys, "distance": distances})

    reads = table(spark, sf, "conversations").where("turn = 0").select("conv_id", F.substring(dna("text"), 1, 40).alias("head")).where(F.length("head") == 40)
    hit = reads.withColumn("h", nearest("head"))
    return hit.select("conv_id", "h.item_id", F.round("h.distance", 4).alias("distance"), (F.col("h.distance") >= 5).alias("ejected"))
