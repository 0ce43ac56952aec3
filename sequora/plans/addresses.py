"""Queries on strand addresses: a line item reads the address of its order, with the changes its own numbers make."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import addresses as A
from ..session import table
from .base import query

_W = int.from_bytes(bytes(A.WHITENING), "big")
_READS = f"""SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AND l_linenumber = 1 AND l_quantity > 40 AS blurred,
    xor(xor(xor((l_orderkey << 8), {_W}), (l_partkey % 4) << CAST(2 * (l_suppkey % 16) AS BIGINT)),
        CASE WHEN l_linenumber > 3 THEN CAST(l_quantity AS BIGINT) % 4 << CAST(2 * (l_partkey % 16) AS BIGINT) ELSE 0 END) AS code FROM lineitem"""


def address_reads(spark, sf):
    """A read a line item: its order's address, one or two bases of it changed, a few unreadable."""
    shift = lambda value, by: F.call_function("shiftleft", value.cast("long"), (2 * by).cast("int"))
    first = shift(F.col("l_partkey") % 4, F.col("l_suppkey") % 16)
    second = F.when(F.col("l_linenumber") > 3, shift(F.col("l_quantity").cast("long") % 4, F.col("l_partkey") % 16)).otherwise(F.lit(0).cast("long"))
    dna = A.address_dna(A.address_code(F.col("l_orderkey")).bitwiseXOR(first).bitwiseXOR(second))
    blurred = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1) & (F.col("l_quantity") > 40)
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", dna.alias("dna"), blurred.alias("blurred"))
    return rows.select("l_orderkey", F.when(F.col("blurred"), F.concat(F.substring("dna", 1, 3), F.lit("N"), F.substring("dna", 5, 99))).otherwise(F.col("dna")).alias("dna"))


def address_references(spark, sf):
    strand = F.col("o_orderkey").alias("strand")
    return table(spark, sf, "orders").where(F.col("o_orderstatus") != "P").select(strand, A.address_code(F.col("o_orderkey")).alias("code"))


_CHANGES = "(SELECT 0::BIGINT AS c, 0 AS d UNION ALL SELECT c << (2 * p), 1 FROM one UNION ALL SELECT xor(a.c << (2 * a.p), b.c << (2 * b.p)), 2 FROM one a JOIN one b ON a.p < b.p)"
_ASSIGNED = f"""WITH one AS (SELECT c, p FROM range(1, 4) t(c), range(16) u(p)), changes AS MATERIALIZED {_CHANGES}, r AS MATERIALIZED ({_READS}),
    refs AS (SELECT o_orderkey AS strand, xor(o_orderkey << 8, {_W}) AS code FROM orders WHERE o_orderstatus <> 'P'),
    keys AS MATERIALIZED (SELECT k.code, xor(k.code, c.c) AS key, d FROM (SELECT DISTINCT code FROM r WHERE NOT blurred) k, changes c),
    near AS (SELECT keys.code, min(CAST(d AS BIGINT) * 1099511627776 + strand) AS best FROM keys JOIN refs ON refs.code = keys.key GROUP BY keys.code),
    a AS (SELECT CASE WHEN blurred THEN 'unreadable' WHEN best IS NULL THEN 'unknown' WHEN best >> 40 = 0 THEN 'exact' ELSE 'near' END AS outcome, CASE WHEN NOT blurred THEN best & 1099511627775 END AS strand, CASE WHEN NOT blurred THEN best >> 40 END AS changed FROM r LEFT JOIN near USING (code))"""


@query("address_clusters", f"{_ASSIGNED} SELECT strand, count(strand) AS reads, count(*) FILTER (outcome = 'near') AS near, count(*) FILTER (strand IS NULL) AS discarded FROM a GROUP BY strand")
def address_clusters(spark, sf):
    return A.clusters(A.by_address(address_reads(spark, sf), "dna", address_references(spark, sf)))


@query("address_outcomes", f"{_ASSIGNED} SELECT outcome, changed, count(*) AS n FROM a GROUP BY 1, 2")
def address_outcomes(spark, sf):
    return A.by_address(address_reads(spark, sf), "dna", address_references(spark, sf)).groupBy("outcome", "changed").agg(F.count(F.lit(1)).alias("n"))


@query(
    "address_range",
    f"""SELECT in_range, count(*) AS n, CAST(sum(changed) AS BIGINT) AS changed FROM (
    SELECT (xor(code, {_W}) >> 8) < (SELECT count(*) FROM orders) AND xor(code, {_W}) & 255 = 0 AS in_range,
        bit_count((d | (d >> 1)) & 1431655765) AS changed FROM (SELECT code, xor(code, xor(l_orderkey << 8, {_W})) AS d FROM ({_READS}) WHERE NOT blurred)) GROUP BY 1""",
)
def address_range(spark, sf):
    strands = table(spark, sf, "orders").count()
    code = address_reads(spark, sf).select("l_orderkey", A.read_code(F.col("dna")).alias("code")).where("code is not null")
    each = code.select(A.in_range(F.col("code"), strands).alias("in_range"), A.changed_bases(F.col("code"), A.address_code(F.col("l_orderkey"))).alias("changed"))
    return each.groupBy("in_range").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("changed").cast("long")).alias("changed"))


_KEPT = "coalesce(text, '') <> '' AND source <> 'src1'"


@query(
    "address_verify",
    f"""WITH p AS (SELECT doc_id AS strand, substr(sha256(text), 1, 32) AS derived FROM documents WHERE {_KEPT}),
    a AS (SELECT d.doc_id AS strand, substr(sha256(CASE WHEN quality = 0 THEN upper(text) ELSE text END), 1, 32) AS address FROM documents d JOIN labels USING (doc_id)),
    f AS (SELECT doc_id AS strand, 0 AS o FROM documents WHERE n_chars < 60
        UNION ALL SELECT a.strand, CASE WHEN derived IS NULL THEN 1 ELSE 2 END FROM a LEFT JOIN p USING (strand) WHERE derived IS DISTINCT FROM address)
    SELECT strand, CASE min(o) WHEN 0 THEN 'known' WHEN 1 THEN 'missing' ELSE 'changed' END AS reason FROM f GROUP BY strand""",
)
def address_verify(spark, sf):
    d = table(spark, sf, "documents")
    payloads = d.where((F.coalesce("text", F.lit("")) != "") & (F.col("source") != "src1")).select(F.col("doc_id").alias("strand"), F.col("text").alias("payload"))
    written = F.when(F.col("quality") == 0, F.upper("text")).otherwise(F.col("text"))
    registry = d.join(table(spark, sf, "labels"), "doc_id").select(F.col("doc_id").alias("strand"), A.derived_address(written).alias("address"))
    return A.address_erasures(payloads, registry, d.where("n_chars < 60").select(F.col("doc_id").alias("strand")))
