"""Queries with k-mer joins: index, similarity, assignment with a margin, clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import kmer
from ..operators.bases import dna
from ..session import table
from .base import dna_sql, query

REFS = f"SELECT item_id, {dna_sql('text')} AS dna FROM benchmark"


def _kmers_sql(source: str, key: str, k: int) -> str:
    return f"SELECT DISTINCT {key}, substr(dna, CAST(unnest(range(1, length(dna) - {k - 2})) AS BIGINT), {k}) AS kmer FROM ({source}) WHERE length(dna) >= {k}"


def references(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", S.bytes_to_dna("text").alias("dna"))


@query("kmer_index", f"SELECT kmer, count(*) AS n_refs, min(item_id) AS first_ref FROM ({_kmers_sql(REFS, 'item_id', 12)}) GROUP BY kmer")
def kmer_index(spark, sf):
    return kmer.index(references(spark, sf), "item_id", "dna", 12).groupBy("kmer").agg(F.count(F.lit(1)).alias("n_refs"), F.min("item_id").alias("first_ref"))


_PAIRS = f"WITH k AS ({_kmers_sql(REFS, 'item_id', 16)}) SELECT a.item_id AS a, b.item_id AS b, count(*) AS shared FROM k a JOIN k b ON a.kmer = b.kmer AND a.item_id < b.item_id GROUP BY 1, 2"


@query("kmer_pairs", _PAIRS)
def kmer_pairs(spark, sf):
    return kmer.pairs(references(spark, sf), "item_id", "dna", 16)


@query("kmer_jaccard", f"WITH n AS (SELECT item_id, count(*) AS n FROM ({_kmers_sql(REFS, 'item_id', 16)}) GROUP BY 1) SELECT a, b, round(1 - shared / (x.n + y.n - shared), 6) AS distance FROM ({_PAIRS}) JOIN n x ON x.item_id = a JOIN n y ON y.item_id = b")
def kmer_jaccard(spark, sf):
    return kmer.jaccard(references(spark, sf), "item_id", "dna", 16)


_READS = f"SELECT conv_id * 1000 + turn AS read_id, {dna_sql('text')} AS dna FROM conversations"
_BEST = f"""WITH r AS ({_kmers_sql(_READS, 'read_id', 20)}), k AS ({_kmers_sql(REFS, 'item_id', 20)}),
c AS (SELECT read_id, item_id, count(*) AS n FROM r JOIN k USING (kmer) GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY n DESC, item_id) AS rk, lead(n) OVER (PARTITION BY read_id ORDER BY n DESC, item_id) AS second FROM c)
SELECT read_id, item_id, n AS overlap, n - coalesce(second, 0) AS margin FROM o WHERE rk = 1 AND n >= 3 AND n - coalesce(second, 0) >= 2"""


@query("kmer_best_match_margin", _BEST)
def kmer_best_match_margin(spark, sf):
    reads = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("read_id"), dna("text").alias("dna"))
    return kmer.best_match(reads, "read_id", references(spark, sf), "item_id", "dna", k=20, least=3, margin=2)


@query("kmer_leader_clusters")
def kmer_leader_clusters(spark, sf):
    return kmer.leader_clusters(references(spark, sf), "item_id", "dna", k=16, share=0.5)


@query(
    "search_keyword_index",
    """WITH w AS (SELECT doc_id, t[i] AS word, CAST(i AS BIGINT) AS at FROM (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS t, unnest(range(1, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) + 1)) AS i FROM documents)),
    q AS (SELECT item_id, list_max(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS word FROM benchmark)
    SELECT item_id, count(*) AS hits, count(DISTINCT doc_id) AS docs FROM q JOIN w USING (word) GROUP BY item_id""",
)
def search_keyword_index(spark, sf):
    words = lambda c: F.regexp_extract_all(F.col(c), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    w = table(spark, sf, "documents").select("doc_id", F.explode(words("text")).alias("word"))
    q = table(spark, sf, "benchmark").select("item_id", F.array_max(words("text")).alias("word"))
    return q.join(w, "word").groupBy("item_id").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("doc_id").alias("docs"))


@query("cluster_by_prefix", f"SELECT substr(dna, 1, 16) AS address, count(*) AS n, min(doc_id) AS first_doc, max(length(dna)) AS longest FROM (SELECT doc_id, {dna_sql('text')} AS dna FROM documents) WHERE length(dna) >= 16 GROUP BY 1")
def cluster_by_prefix(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", S.bytes_to_dna("text").alias("dna")).where(F.length("dna") >= 16)
    return d.groupBy(F.substring("dna", 1, 16).alias("address")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"), F.max(F.length("dna")).cast("long").alias("longest"))


@query(
    "crispr_search",
    f"""WITH r AS (SELECT item_id, {dna_sql('text')} AS dna FROM benchmark),
    p AS (SELECT item_id, "at", substr(dna, "at", 23) AS w FROM (SELECT item_id, dna, CAST(unnest(range(1, length(dna) - 21)) AS INT) AS "at" FROM r)),
    h AS (SELECT g.item_id AS guide, p.item_id, p."at", list_filter(range(1, 21), lambda k: w[k] <> g.dna[k]) AS differ
      FROM r g, p WHERE length(g.dna) >= 20 AND regexp_full_match(w, '[ACGT]{{21}}GG'))
    SELECT guide, item_id, "at", CAST(len(differ) AS INT) AS mismatches, CAST(len(differ) + 0.5 * len(list_filter(differ, lambda k: k > 8)) AS DOUBLE) AS penalty FROM h WHERE len(differ) <= 2""",
)
def crispr_search(spark, sf):
    """Guides (first 20 bases of each reference) in every reference, two mismatches at most, before NGG."""
    refs = references(spark, sf)
    guides = refs.where(F.length("dna") >= 20).select(F.col("item_id").alias("guide"), F.substring("dna", 1, 20).alias("g"))
    return kmer.guided_search(guides, refs, "item_id", "dna", most=2)
