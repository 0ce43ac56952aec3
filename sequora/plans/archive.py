"""Queries on archives, journals, catalogs and intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import archive as A
from ..operators import intervals as I
from ..session import table
from .base import query

BLOCKS = "SELECT doc_id, source, CAST(unnest(range(len(c))) AS BIGINT) AS i, unnest(c) AS chunk FROM (SELECT doc_id, source, regexp_extract_all(text, '(?s).{1,256}') AS c FROM documents)"


def blocks(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source", F.posexplode(S.chunks("text", 256)).alias("i", "chunk")).withColumn("i", F.col("i").cast("long"))


@query("dedup_ratio", "SELECT count(*) AS blocks, count(DISTINCT chunk) AS distinct_blocks, round(1 - count(DISTINCT chunk) / count(*), 6) AS saved FROM (" + BLOCKS + ")")
def dedup_ratio(spark, sf):
    n = blocks(spark, sf).groupBy(F.sha2("chunk", 256).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.sum("n").alias("blocks"), F.count(F.lit(1)).alias("distinct_blocks"), F.round(1 - F.count(F.lit(1)) / F.sum("n"), 6).alias("saved"))


@query("chunk_hash", f"SELECT doc_id, i, sha256(chunk) AS digest FROM ({BLOCKS})")
def chunk_hash(spark, sf):
    return blocks(spark, sf).select("doc_id", "i", F.sha2("chunk", 256).alias("digest"))


_LEVEL = "SELECT doc_id, i // 2 AS i, sha256(max(CASE WHEN i % 2 = 0 THEN d END) || coalesce(max(CASE WHEN i % 2 = 1 THEN d END), max(CASE WHEN i % 2 = 0 THEN d END))) AS d FROM ({}) GROUP BY doc_id, i // 2"


@query("merkle_level1", "SELECT doc_id, i, d AS digest FROM (" + _LEVEL.format(f"SELECT doc_id, i, sha256(chunk) AS d FROM ({BLOCKS})") + ")")
def merkle_level1(spark, sf):
    return A.merkle_level(chunk_hash(spark, sf), ["doc_id"], "i", "digest")


@query(
    "merkle_root",
    f"""WITH RECURSIVE top AS (SELECT max(i) + 1 AS n FROM ({BLOCKS})),
    t(step, n, rows) AS (
      SELECT 0, (SELECT n FROM top), (SELECT list({{'doc_id': doc_id, 'i': i, 'd': sha256(chunk)}}) FROM ({BLOCKS}))
      UNION ALL
      SELECT step + 1, (n + 1) // 2, (SELECT list({{'doc_id': doc_id, 'i': i, 'd': d}}) FROM ({_LEVEL.format("SELECT r.doc_id, r.i, r.d FROM (SELECT unnest(rows) AS r)")}))
      FROM t WHERE n > 1)
    SELECT r.doc_id, r.d AS root FROM (SELECT unnest(rows) AS r FROM t WHERE n = 1)""",
)
def merkle_root(spark, sf):
    return A.merkle_roots(chunk_hash(spark, sf), ["doc_id"], "i", "digest")


_CAT = "SELECT doc_id, source, 4 * octet_length(encode(text)) AS nt FROM documents"


def catalog(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source", "lang", (4 * F.octet_length("text")).cast("long").alias("nt"))


@query("catalog_offsets", f"SELECT doc_id, source, nt, CAST(coalesce(sum(nt) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM ({_CAT})")
def catalog_offsets(spark, sf):
    return A.running_offsets(catalog(spark, sf).drop("lang"), ["source"], ["doc_id"], "nt")


@query("catalog_stats", f"SELECT source AS pool, count(*) AS files, CAST(sum(nt) AS BIGINT) AS nt, CAST(sum(nt) // 4 AS BIGINT) AS bytes, round(sum(nt) / 4 * 8 / sum(nt), 6) AS density FROM ({_CAT}) WHERE doc_id % 10 <> 3 GROUP BY source")
def catalog_stats(spark, sf):
    """Files that are not deleted; here every id that ends in 3 is a tombstone."""
    c = catalog(spark, sf).withColumn("deleted", F.col("doc_id") % 10 == 3).where("not deleted")
    return c.groupBy(F.col("source").alias("pool")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("nt").alias("nt"), F.floor(F.sum("nt") / 4).alias("bytes"), F.round(F.sum("nt") / 4 * 8 / F.sum("nt"), 6).alias("density")
    )


@query("range_slice", f"SELECT doc_id, i FROM ({BLOCKS}) WHERE i BETWEEN 2 AND 4")
def range_slice(spark, sf):
    return blocks(spark, sf).where(F.col("i").between(2, 4)).select("doc_id", "i")


_EV = "SELECT event_id, user_id, event_type, ts, value FROM events"


@query("journal_latest", f"SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rk FROM ({_EV})) WHERE rk = 1 AND event_type <> (SELECT min(event_type) FROM events)")
def journal_latest(spark, sf):
    e = table(spark, sf, "events")
    tombstone = e.agg(F.min("event_type").alias("gone"))
    return A.latest(e, ["user_id", "event_type"], "ts", "event_id", F.lit(False)).join(F.broadcast(tombstone), F.col("event_type") == F.col("gone"), "left_anti").select("user_id", "event_type", "event_id", "value")


@query("journal_queue", "SELECT user_id, count(*) AS entries, count(*) * 16 AS bytes FROM events GROUP BY user_id")
def journal_queue(spark, sf):
    return A.synthesis_queue(table(spark, sf, "events"), ["user_id"])


@query("journal_levels", "SELECT user_id, event_id, level FROM (SELECT user_id, event_id, ts, event_id % 4 AS level, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 4, ts DESC, event_id DESC) AS rk FROM events) WHERE rk = 1")
def journal_levels(spark, sf):
    e = table(spark, sf, "events").withColumn("level", F.col("event_id") % 4)
    return A.layered_lookup(e, ["user_id"], "level", "ts", "event_id").select("user_id", "event_id", "level")


@query("missing_left_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def missing_left_anti(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("left_outer_erasures", "SELECT d.doc_id, l.doc_id IS NULL AS erased, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def left_outer_erasures(spark, sf):
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels")
    return d.select("doc_id").join(l.select("doc_id", "quality", F.lit(False).alias("e")), "doc_id", "left").select("doc_id", F.coalesce("e", F.lit(True)).alias("erased"), "quality")


@query("block_asof", "SELECT e.event_id, o.o_orderkey FROM (SELECT event_id, ts, user_id % 100 AS k FROM events) e ASOF LEFT JOIN (SELECT o_custkey % 100 AS k, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2) o ON e.k = o.k AND e.ts >= o.o_orderdate")
def block_asof(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", (F.col("user_id") % 100).alias("k"))
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 100).alias("k"), "o_orderdate", "o_orderkey")
    return I.asof_backward(e, o, ["k"], "ts", "o_orderdate", ["o_orderkey"]).select("event_id", F.col("matched_o_orderkey").alias("o_orderkey"))


_DAYS = "SELECT l_suppkey, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS s, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate"


def spans(spark, sf):
    day = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date")).cast("long")
    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).where("l_shipdate >= o_orderdate")
    return j.select("l_suppkey", day("o_orderdate").alias("s"), day("l_shipdate").alias("e"))


@query(
    "interval_merge",
    f"""WITH f AS (SELECT *, max(e) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM ({_DAYS})),
    g AS (SELECT *, sum(CASE WHEN far IS NULL OR s > far THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM f)
    SELECT l_suppkey, min(s) AS s, max(e) AS e, count(*) AS members FROM g GROUP BY l_suppkey, g""",
)
def interval_merge(spark, sf):
    return I.merge_intervals(spans(spark, sf), ["l_suppkey"], "s", "e")


@query(
    "bin_range_join",
    """WITH p AS (SELECT p_partkey, p_size * 1000 AS ps, p_size * 1000 + 1500 AS pe FROM part),
    c AS (SELECT c_custkey, CAST(floor(c_acctbal * 5) AS BIGINT) AS cs, CAST(floor(c_acctbal * 5) AS BIGINT) + 200 AS ce FROM customer WHERE c_acctbal >= 0)
    SELECT c_custkey, count(*) AS n, min(p_partkey) AS first_part FROM c JOIN p ON cs < pe AND ps < ce GROUP BY c_custkey""",
)
def bin_range_join(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_size").cast("long") * 1000).alias("ps")).withColumn("pe", F.col("ps") + 1500)
    c = table(spark, sf, "customer").where("c_acctbal >= 0").select("c_custkey", F.floor(F.col("c_acctbal") * 5).alias("cs")).withColumn("ce", F.col("cs") + 200)
    found = I.overlap_counts(c, p, "cs", "ce", "ps", "pe", "p_partkey", 1000)
    return found.groupBy("c_custkey").agg(F.sum("n").alias("n"), F.min("least").alias("first_part"))


@query("genomic_bins", "SELECT bin, count(*) AS n FROM (SELECT CASE WHEN s // 16384 = (e - 1) // 16384 THEN 4681 + s // 16384 WHEN s // 131072 = (e - 1) // 131072 THEN 585 + s // 131072 WHEN s // 1048576 = (e - 1) // 1048576 THEN 73 + s // 1048576 WHEN s // 8388608 = (e - 1) // 8388608 THEN 9 + s // 8388608 WHEN s // 67108864 = (e - 1) // 67108864 THEN 1 + s // 67108864 ELSE 0 END AS bin FROM (SELECT l_orderkey * 997 AS s, l_orderkey * 997 + CAST(l_extendedprice AS BIGINT) + 1 AS e FROM lineitem)) GROUP BY bin")
def genomic_bins(spark, sf):
    x = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 997).alias("s"), (F.col("l_orderkey") * 997 + F.rint("l_extendedprice").cast("long") + 1).alias("e"))
    return x.groupBy(I.genomic_bin(F.col("s"), F.col("e")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("file_ranges", f"WITH o AS (SELECT doc_id, source, start, start + nt AS stop FROM (SELECT doc_id, source, nt, coalesce(sum(nt) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM ({_CAT}))) SELECT source, CAST(x * 50000 AS BIGINT) AS position, doc_id FROM o, LATERAL (SELECT unnest(range(CAST(start + 49999 AS BIGINT) // 50000, CAST(stop + 49999 AS BIGINT) // 50000)) AS x)")
def file_ranges(spark, sf):
    """Which file holds every 50 000th base of a pool: as-of lookup on running offsets."""
    o = catalog_offsets(spark, sf).withColumn("stop", F.col("start") + F.col("nt"))
    x = F.sequence(F.ceil(F.col("start") / 50000), F.ceil(F.col("stop") / 50000) - 1)
    has = F.ceil(F.col("start") / 50000) < F.ceil(F.col("stop") / 50000)
    return o.where(has).select("source", F.explode(x).alias("x"), "doc_id").select("source", (F.col("x") * 50000).alias("position"), "doc_id")


@query("xor_parity", "WITH h AS (SELECT source, hex(encode(text)) AS h FROM documents), p AS (SELECT source, h, unnest(range(0, length(h) // 2)) AS pos FROM h) SELECT source, pos, CAST(bit_xor(CAST('0x' || substr(h, CAST(2 * pos + 1 AS BIGINT), 2) AS INT)) AS BIGINT) AS parity FROM p GROUP BY source, pos")
def xor_parity(spark, sf):
    return A.xor_parity(table(spark, sf, "documents"), ["source"], "text").withColumn("pos", F.col("pos").cast("long"))


@query("interleave_perm", r"WITH c AS (SELECT doc_id, regexp_extract_all(text, '(?s).') AS a FROM documents WHERE length(text) > 0), w AS (SELECT doc_id, a, len(a) AS n, CAST(ceil(len(a) / 8) AS BIGINT) AS w FROM c) SELECT doc_id, md5(array_to_string(list_transform(list_filter(flatten(list_transform(range(w), lambda c: list_transform(range(8), lambda r: r * w + c))), lambda i: i < n), lambda i: a[i + 1]), '')) AS digest FROM w")
def interleave_perm(spark, sf):
    d = table(spark, sf, "documents").where(F.length("text") > 0).select("doc_id", F.regexp_extract_all("text", F.lit("(?s)(.)"), F.lit(1)).alias("a"))
    return d.select("doc_id", F.md5(F.array_join(A.interleave(F.col("a"), 8), "").cast("binary")).alias("digest"))


@query("stride_perm", "SELECT doc_id, md5(array_to_string(list_transform(range(len(a)), lambda i: a[(i * 7919) % len(a) + 1]), '')) AS digest FROM (SELECT doc_id, regexp_extract_all(text, '(?s).') AS a FROM documents WHERE length(text) > 0)")
def stride_perm(spark, sf):
    d = table(spark, sf, "documents").where(F.length("text") > 0).select("doc_id", F.regexp_extract_all("text", F.lit("(?s)(.)"), F.lit(1)).alias("a"))
    moved = F.transform(A.stride_positions(F.size("a"), 7919), lambda i: F.get(F.col("a"), i.cast("int")))
    return d.select("doc_id", F.md5(F.array_join(moved, "").cast("binary")).alias("digest"))
