"""Source divergence audit: how far each source's use of words stands from its language's other sources.

Terms are runs of letters and non-ASCII characters. A language keeps the terms that enough of
its documents hold. Every (lang, source) group, and every language, gives each kept term a
smoothed share p of 10**9; the divergence of shares p and q is floor((p - q)**2 / q), in exact
integers. Part ``pair`` sums it over the kept terms against each other source of the language,
part ``term`` lists the terms by which a source stands out from its language.

All relational: matches are exploded (a document's distinct terms beside all of its terms, so
that one aggregation, combined before its shuffle, counts occurrences and documents), the
kept vocabulary meets the groups of its language to write the zeros down, and the dense table
meets itself on language and term. The vocabulary is dealt by a hash of the term in that
first join, so a language that holds most of it is spread; the self-join has a row a source
under each key. The dense table has groups x vocabulary rows, and the result of part ``pair``
is every ordered pair of sources of a language: both follow from the report asked for.

Defined cases: null text, lang or source count as ''; every row is a document, repeated rows
too; a document without terms still makes its group known; a language that keeps no term has
pairs of value 0 and no terms; equal values rank by the item's UTF-8 bytes; very long texts are
read whole; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, discard, documents, store

#: What stands between terms; a term is a match of ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+``.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UNIT = 1_000_000_000


def term_counts(docs: DataFrame, columns: tuple[str, str, str] = ("text", "lang", "source"), shards: int = 4) -> DataFrame:
    """(lang, source, term, n occurrences, df documents).

    Texts of a group are brought together first, in ``shards`` by a hash of the text that adaptive
    execution may split further, so that a task counts the words of few groups and hands on a row
    a word. The shard is no key of the counts, so a large group is never counted in one task.
    """
    text, lang, source = (F.coalesce(F.col(c), F.lit("")) for c in columns)
    shard = F.pmod(F.xxhash64(text), F.lit(shards)).alias("shard")
    texts = docs.select(lang.alias("lang"), source.alias("source"), text.alias("text"), shard).hint("rebalance", F.col("lang"), F.col("source"), F.col("shard"))
    terms = F.split(ascii_lower(F.col("text")), BETWEEN)  # the same matches as by extraction, in half the time, and empty ends
    rows = texts.select("lang", "source", terms.alias("terms"))
    both = rows.select("lang", "source", F.posexplode(F.array(F.array_distinct("terms"), "terms")).alias("kind", "terms"))
    each = both.select("lang", "source", "kind", F.explode("terms").alias("term")).where("term <> ''")
    return each.groupBy("lang", "source", "term").agg(F.sum(F.col("kind").cast("long")).alias("n"), F.sum((1 - F.col("kind")).cast("long")).alias("df"))


def share(count: str, total: str, kept: str) -> Column:
    """1 + floor(10**9 * (count + 1) / (total + kept)): in longs while they hold it, else in decimals; exact in both."""
    wide = f"(cast({count} + 1 as decimal(20,0)) * {UNIT}) div cast({total} + {kept} as decimal(20,0))"
    return F.expr(f"1 + if({count} < {2**63 // UNIT - 1}, (({count} + 1) * {UNIT}L) div ({total} + {kept}), {wide})")


def divergence(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def _ranked(df: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return df.withColumn("rank", F.row_number().over(order))


def audit(docs: DataFrame, least_documents: int = 3, most_terms: int = 200, salts: int = 64, columns: tuple[str, str, str] = ("text", "lang", "source")) -> DataFrame:
    """lang, source, part, item, value, rank; ``most_terms`` is how far the report of terms goes."""
    counts = store(term_counts(docs, columns))
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("df").alias("df")).where(F.col("df") >= least_documents).drop("df")
    kept = store(kept)
    used = store(counts.join(kept.select("lang", "term"), ["lang", "term"], "left_semi").select("lang", "source", "term", "n"))
    _, lang, source = (F.coalesce(F.col(c), F.lit("")) for c in columns)
    groups = docs.select(lang.alias("lang"), source.alias("source")).distinct()
    sums = used.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    langs = kept.groupBy("lang").agg(F.sum("total").alias("whole"), F.count(F.lit(1)).alias("size"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    groups = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = store(groups.select("lang", "source", zero("own"), zero("whole"), zero("size"), F.monotonically_increasing_id().alias("g")))

    salted = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(salts)))
    dealt = groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    cells = salted.join(dealt, ["lang", "salt"]).join(used, ["lang", "source", "term"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    dense = store(cells.select("lang", "term", "g", "n", share("n", "own", "size").alias("p"), share("total", "whole", "size").alias("q")))

    a = dense.select("lang", "term", F.col("g").alias("a"), F.col("p").alias("pa"))
    b = dense.select("lang", "term", F.col("g").alias("b"), F.col("p").alias("pb"))
    between = a.join(b, ["lang", "term"]).where("a < b").groupBy("a", "b").agg(F.sum(divergence("pa", "pb")).alias("ab"), F.sum(divergence("pb", "pa")).alias("ba"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("g"), F.col("b").alias("other"), F.col("ab").alias("value")), F.struct(F.col("b").alias("g"), F.col("a").alias("other"), F.col("ba").alias("value"))))
    between = between.select(ways.alias("w")).select("w.g", "w.other", "w.value")
    pairs = groups.select("lang", "source", "g").join(groups.select("lang", F.col("source").alias("item"), F.col("g").alias("other")), "lang").where("g <> other")
    pairs = pairs.join(between, ["g", "other"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0)).alias("value"))
    terms = dense.where("n > 0 and p > q").join(groups.select("g", "source"), "g").select("lang", "source", F.col("term").alias("item"), divergence("p", "q").alias("value"))
    parts = [_ranked(pairs).withColumn("part", F.lit("pair")), _ranked(terms).where(F.col("rank") <= most_terms).withColumn("part", F.lit("term"))]
    out = store(parts[0].unionByName(parts[1]).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank")))
    discard(counts, kept, used, groups, dense)
    return out


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS row,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
m AS (SELECT lang, source, row, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM m GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM m SEMI JOIN kept USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, sum(total) AS whole, count(*) AS size FROM kept GROUP BY lang),
g AS (
  SELECT lang, source, coalesce(own, 0) AS own, coalesce(whole, 0) AS whole, coalesce(size, 0) AS size
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS own FROM c GROUP BY ALL) USING (lang, source) LEFT JOIN l USING (lang)),
dense AS (
  SELECT lang, source, term, coalesce(n, 0) AS n,
         1 + 1000000000::HUGEINT * (coalesce(n, 0) + 1) // (own + size)::HUGEINT AS p,
         1 + 1000000000::HUGEINT * (total + 1) // (whole + size)::HUGEINT AS q
  FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
between_ AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(v.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN between_ v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM dense WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT * FROM (SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS r FROM terms) WHERE r <= 200)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked
"""
