"""Queries on reads: a conversation is a cluster, its turns' texts are the reads."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import reads as R
from ..operators.bases import dna
from ..session import table
from .base import dna_sql, query

DNA = f"SELECT conv_id, turn, conv_id * 100 + turn AS read, role, {dna_sql('text')} AS dna FROM conversations"
POS = f"SELECT conv_id, turn, read, role, p - 1 AS pos, substr(dna, p, 1) AS base, 10 + (read * 7 + (p - 1) * 13) % 31 AS q FROM (SELECT *, unnest(range(1, length(dna) + 1)) AS p FROM ({DNA}))"
LEN = f"SELECT conv_id, CAST(floor(quantile_cont(length(dna), 0.5)) AS INT) AS len FROM ({DNA}) GROUP BY conv_id"


def reads(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", "role", (F.col("conv_id") * 100 + F.col("turn")).alias("read"), dna("text").alias("dna"))


def _vote_sql(weight: str) -> str:
    return f"""WITH w AS (SELECT conv_id, pos, base, {weight} AS w FROM ({POS}) GROUP BY 1, 2, 3),
    b AS (SELECT *, row_number() OVER (PARTITION BY conv_id, pos ORDER BY w DESC, base) AS rk FROM w)
    SELECT conv_id, string_agg(base, '' ORDER BY pos) AS consensus FROM b JOIN ({LEN}) l USING (conv_id) WHERE rk = 1 AND pos < len GROUP BY conv_id"""


@query("consensus_majority", _vote_sql("count(*)"))
def consensus_majority(spark, sf):
    return R.consensus(reads(spark, sf), "conv_id", "read", "dna", "majority")


@query("consensus_weighted", _vote_sql("round(sum(1 - pow(10.0, -q / 10.0)), 9)"))
def consensus_weighted(spark, sf):
    return R.consensus(reads(spark, sf), "conv_id", "read", "dna", "weighted")


@query(
    "consensus_bayes",
    f"""WITH s AS (SELECT conv_id, pos, base, sum(ln(1 - pow(10.0, -q / 10.0))) AS r, sum(ln(pow(10.0, -q / 10.0) / 3)) AS w FROM ({POS}) GROUP BY 1, 2, 3),
    t AS (SELECT *, r + sum(w) OVER wd - w AS sc, sum(w) OVER wd AS u, count(*) OVER wd AS n FROM s WINDOW wd AS (PARTITION BY conv_id, pos)),
    m AS (SELECT *, greatest(max(sc) OVER (PARTITION BY conv_id, pos), u) AS top FROM t),
    p AS (SELECT conv_id, pos, base, exp(sc - top) / (sum(exp(sc - top)) OVER (PARTITION BY conv_id, pos) + (4 - n) * exp(u - top)) AS p FROM m)
    SELECT conv_id, count(*) AS n_calls, count(*) FILTER (p >= 0.7) AS certain, round(sum(p), 3) AS mass FROM p GROUP BY conv_id""",
)
def consensus_bayes(spark, sf):
    p = R.posteriors(reads(spark, sf), "conv_id", "read", "dna")
    return p.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_calls"), F.count(F.when(F.col("p") >= 0.7, 1)).alias("certain"), F.round(F.sum("p"), 3).alias("mass"))


_CALLS = f"""SELECT conv_id, pos, base, round(w / total, 6) AS confidence, (round(w / total, 6) < 0.6 OR quality < 15) AS erased FROM (
    SELECT *, sum(w) OVER wd AS total, sum(q) OVER wd / sum(w) OVER wd AS quality, row_number() OVER (PARTITION BY conv_id, pos ORDER BY w DESC, base) AS rk
    FROM (SELECT conv_id, pos, base, count(*) AS w, sum(q) AS q FROM ({POS}) GROUP BY 1, 2, 3) WINDOW wd AS (PARTITION BY conv_id, pos)) WHERE rk = 1"""


def calls(spark, sf):
    return R.soft_calls(reads(spark, sf), "conv_id", "read", "dna")


@query("consensus_soft", f"SELECT conv_id, count(*) AS n, count(*) FILTER (erased) AS n_erased, round(avg(confidence), 5) AS confidence FROM ({_CALLS}) GROUP BY conv_id")
def consensus_soft(spark, sf):
    return calls(spark, sf).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("erased"), 1)).alias("n_erased"), F.round(F.avg("confidence"), 5).alias("confidence"))


@query("erasure_map", f"SELECT conv_id, count(DISTINCT pos // 4) AS n, CAST(sum(DISTINCT pos // 4) AS BIGINT) AS total FROM ({_CALLS}) WHERE erased GROUP BY conv_id")
def erasure_map(spark, sf):
    e = R.byte_erasures(calls(spark, sf), "conv_id")
    return e.select("conv_id", F.size("erasures").cast("long").alias("n"), F.aggregate("erasures", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("cap_erasures", f"SELECT conv_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY confidence, pos) AS rk FROM ({_CALLS}) WHERE erased) WHERE rk <= 8")
def cap_erasures(spark, sf):
    return R.capped_erasures(calls(spark, sf), "conv_id", 8).select("conv_id", F.col("pos").cast("long").alias("pos"))


@query(
    "triage_buckets",
    f"""WITH c AS (SELECT conv_id, pos, base, count(*) AS w, sum(q) AS q FROM ({POS}) GROUP BY 1, 2, 3),
    p AS (SELECT conv_id, pos, max(w) / sum(w) AS share, sum(w) AS n, sum(q) AS q FROM c GROUP BY 1, 2),
    s AS (SELECT conv_id, round(avg(share), 6) AS agreement, round(sum(q) / sum(n), 6) AS quality FROM p GROUP BY 1),
    r AS (SELECT conv_id, count(*) AS reads FROM ({DNA}) GROUP BY 1)
    SELECT conv_id, reads, round(agreement, 5) AS agreement, round(quality, 5) AS quality, CASE WHEN reads >= 5 AND agreement >= 0.95 AND quality >= 30 THEN 'easy' WHEN reads >= 3 AND agreement >= 0.85 AND quality >= 20 THEN 'medium' ELSE 'hard' END AS bucket
    FROM r JOIN s USING (conv_id)""",
)
def triage_buckets(spark, sf):
    t = R.triage(reads(spark, sf), "conv_id", "read", "dna")
    return t.select("conv_id", "reads", F.round("agreement", 5).alias("agreement"), F.round("quality", 5).alias("quality"), "bucket")


@query(
    "noise_profile",
    f"""WITH e AS (SELECT read, count(*) AS n, sum(q) AS q FROM ({POS}) GROUP BY read)
    SELECT count(*) AS reads, CAST(sum(n) AS BIGINT) AS bases, round(avg(n), 6) AS mean_length, round(sum(q) / sum(n), 6) AS mean_quality,
    count(*) FILTER (q / n < 10) AS low, count(*) FILTER (q / n > 30) AS high, round(pow(10.0, -sum(q) / sum(n) / 10.0), 9) AS rate_of_mean_q,
    round(sum(n * pow(10.0, -q / n / 10.0)) / sum(n), 9) AS mean_of_rates FROM e""",
)
def noise_profile(spark, sf):
    return R.noise_profile(reads(spark, sf), "read", "dna")


@query("quality_histogram", f"SELECT CAST(q AS INT) AS q, count(*) AS n FROM ({POS}) GROUP BY 1")
def quality_histogram(spark, sf):
    return R.positions(reads(spark, sf), "conv_id", "read", "dna").groupBy("q").agg(F.count(F.lit(1)).alias("n"))


@query("length_histogram", f"SELECT least(length(dna) // 100, 99) AS bin, count(*) AS n FROM ({DNA}) GROUP BY 1")
def length_histogram(spark, sf):
    return reads(spark, sf).groupBy(F.least(F.floor(F.length("dna") / 100), F.lit(99)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "platform_rollup",
    f"""WITH e AS (SELECT role, read, count(*) AS n, sum(q) AS q FROM ({POS}) GROUP BY 1, 2)
    SELECT role AS platform, count(*) AS reads, round(avg(n), 5) AS mean_length, round(stddev_pop(n), 5) AS sd_length, round(avg(q / n), 5) AS mean_quality FROM e GROUP BY role""",
)
def platform_rollup(spark, sf):
    r = reads(spark, sf)
    e = R.positions(r, "role", "read", "dna").groupBy("role", "read").agg(F.count(F.lit(1)).alias("n"), F.sum("q").alias("q"))
    return e.groupBy(F.col("role").alias("platform")).agg(F.count(F.lit(1)).alias("reads"), F.round(F.avg("n"), 5).alias("mean_length"), F.round(F.stddev_pop("n"), 5).alias("sd_length"), F.round(F.avg(F.col("q") / F.col("n")), 5).alias("mean_quality"))


_TURNS = f"SELECT conv_id, turn, dna AS a, lead(dna) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM ({DNA})"
_ALIGNED = f"SELECT p - 1 AS pos, least(length(a), length(b)) AS n, substr(a, p, 1) AS x, substr(b, p, 1) AS y FROM (SELECT *, unnest(range(1, least(length(a), length(b)) + 1)) AS p FROM ({_TURNS}) WHERE b IS NOT NULL)"


def turns(spark, sf, column="dna"):
    r = reads(spark, sf) if column == "dna" else table(spark, sf, "conversations").withColumnRenamed("text", "dna")
    after = F.lead("dna").over(Window.partitionBy("conv_id").orderBy("turn"))
    return r.select("conv_id", "turn", F.col("dna").alias("a"), after.alias("b")).where("b is not null")


@query("substitution_matrix", f"SELECT x, y, count(*) AS n FROM ({_ALIGNED}) GROUP BY x, y")
def substitution_matrix(spark, sf):
    return R.substitution_matrix(turns(spark, sf), ["conv_id", "turn"], "a", "b")


@query("positional_error_deciles", f"SELECT CAST(pos * 10 // n AS INT) AS bin, count(*) AS compared, count(*) FILTER (x <> y) AS wrong FROM ({_ALIGNED}) GROUP BY 1")
def positional_error_deciles(spark, sf):
    return R.positional_errors(turns(spark, sf), ["conv_id", "turn"], "a", "b")


@query(
    "bit_error_rate",
    """WITH t AS (SELECT conv_id, turn, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations),
    z AS (SELECT conv_id, turn, hex(encode(a)) AS x, hex(encode(b)) AS y FROM t WHERE b IS NOT NULL),
    p AS (SELECT *, unnest(range(0, greatest(length(x), length(y)) // 2)) AS i FROM z)
    SELECT conv_id, turn, CAST(sum(CASE WHEN 2 * i >= length(x) OR 2 * i >= length(y) THEN 8 ELSE bit_count(xor(CAST('0x' || substr(x, 2 * i + 1, 2) AS INT), CAST('0x' || substr(y, 2 * i + 1, 2) AS INT))) END) AS BIGINT) AS errors, count(*) * 8 AS bits FROM p GROUP BY 1, 2""",
)
def bit_error_rate(spark, sf):
    return R.bit_error_rate(turns(spark, sf, "text"), ["conv_id", "turn"], "a", "b")


@query("phred_weights", "SELECT CAST(q AS INT) AS q, round(pow(10.0, -q / 10.0), 9) AS p, round(1 - pow(10.0, -q / 10.0), 9) AS w, round(CASE WHEN q = 0 THEN -20 ELSE greatest(-20, least(20, ln((1 - pow(10.0, -q / 10.0)) / pow(10.0, -q / 10.0)))) END, 6) AS llr FROM range(0, 94) t(q)")
def phred_weights(spark, sf):
    q = spark.range(94).select(F.col("id").cast("int").alias("q"))
    llr = F.when(F.col("q") == 0, -20.0).otherwise(S.phred_log_odds("q"))
    return q.select("q", F.round(S.phred_error("q"), 9).alias("p"), F.round(1 - S.phred_error("q"), 9).alias("w"), F.round(llr, 6).alias("llr"))
