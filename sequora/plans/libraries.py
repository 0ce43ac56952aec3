"""Queries on libraries of ready-made pieces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import libraries as L
from ..session import settled, table
from .base import query

_WORDS = "SELECT w AS sequence, min(item_id) AS entry FROM (SELECT item_id, unnest(string_split(text, ' ')) AS w FROM benchmark) WHERE regexp_full_match(w, '[a-z]{3,}') GROUP BY 1"


@query(
    "library_tiling",
    f"""WITH w AS ({_WORDS}), p AS (SELECT '(?s)' || string_agg(sequence, '|' ORDER BY length(sequence) DESC, sequence) || '|.' AS pattern FROM w),
    t AS (SELECT doc_id, unnest(regexp_extract_all(text, pattern)) AS piece, generate_subscripts(regexp_extract_all(text, pattern), 1) AS i FROM documents, p),
    s AS (SELECT doc_id, piece, entry, 1 + coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM t LEFT JOIN w ON piece = sequence)
    SELECT doc_id, count(*) AS tiles, count(entry) AS pieces, CAST(coalesce(sum(length(piece)) FILTER (entry IS NOT NULL), 0) AS BIGINT) AS covered,
        CAST(sum(start * coalesce(entry + 1, 0)) AS BIGINT) AS marks FROM s GROUP BY doc_id""",
)
def library_tiling(spark, sf):
    """Every text tiled greedily with the words of the benchmark."""
    word = table(spark, sf, "benchmark").select("item_id", F.explode(F.split("text", " ")).alias("sequence")).where(F.col("sequence").rlike("^[a-z]{3,}$"))
    library = word.groupBy("sequence").agg(F.min("item_id").alias("entry"))
    tiles = L.tile(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("sequence")), library)
    mark = F.col("start").cast("long") * F.coalesce(F.col("entry") + 1, F.lit(0))
    covered = F.coalesce(F.sum(F.when(F.col("entry").isNotNull(), F.col("length"))), F.lit(0))
    return tiles.groupBy(F.col("id").alias("doc_id")).agg(F.count(F.lit(1)).alias("tiles"), F.count("entry").alias("pieces"), covered.alias("covered"), F.sum(mark).alias("marks"))


BLOCK = 12
_READ = """xor(xor(CAST('0x' || substr(md5(CAST(l_partkey AS VARCHAR)), 1, 6) AS BIGINT), CASE WHEN l_linenumber > 2 THEN (l_orderkey % 4) << CAST(2 * (l_suppkey % 12) AS BIGINT) ELSE 0 END),
    CASE WHEN l_linenumber > 4 THEN (CAST(l_quantity AS BIGINT) % 64) << CAST(2 * (l_orderkey % 10) AS BIGINT) ELSE 0 END)"""


def block_code(column: str):
    return F.conv(F.substring(F.md5(F.col(column).cast("string").cast("binary")), 1, 6), 16, 10).cast("long")


def block_dna(code):
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), BLOCK, "0"), "0123", "ACGT")


@query(
    "library_nearest",
    f"""WITH lib AS (SELECT CAST('0x' || substr(md5(CAST(p_partkey AS VARCHAR)), 1, 6) AS BIGINT) AS code, min(p_partkey) AS entry FROM part GROUP BY 1),
    r AS (SELECT {_READ} AS code FROM lineitem), k AS (SELECT DISTINCT code FROM r),
    d AS (SELECT k.code, min(bit_count((x | (x >> 1)) & 5592405) * CAST(1099511627776 AS BIGINT) + entry) AS best FROM (SELECT k.code, entry, xor(k.code, lib.code) AS x FROM k, lib) k GROUP BY 1)
    SELECT best & 1099511627775 AS entry, best >> 40 AS changed, count(*) AS n FROM r JOIN d USING (code) GROUP BY 1, 2""",
)
def library_nearest(spark, sf):
    """Line items whose block is that of their part, with up to four bases changed, and the part whose block is nearest."""
    shift = lambda value, by: F.call_function("shiftleft", value.cast("long"), (2 * by).cast("int"))
    one = F.when(F.col("l_linenumber") > 2, shift(F.col("l_orderkey") % 4, F.col("l_suppkey") % BLOCK)).otherwise(F.lit(0).cast("long"))
    more = F.when(F.col("l_linenumber") > 4, shift(F.col("l_quantity").cast("long") % 64, F.col("l_orderkey") % 10)).otherwise(F.lit(0).cast("long"))
    reads = table(spark, sf, "lineitem").select(block_dna(block_code("l_partkey").bitwiseXOR(one).bitwiseXOR(more)).alias("block"))
    library = table(spark, sf, "part").select(F.col("p_partkey").alias("entry"), block_dna(block_code("p_partkey")).alias("sequence"))
    counted = settled(reads.groupBy("block").agg(F.count(F.lit(1)).alias("n")))  # equal blocks have one nearest piece
    return counted.join(L.nearest(counted, library), "block").groupBy("entry", "changed").agg(F.sum("n").alias("n"))
