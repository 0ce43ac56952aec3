"""Queries on base sequences made of the documents' whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as S
from ..session import table
from .base import YIN_YANG, dna_sql, gc_sql, hp_sql, query

DNA = f"SELECT doc_id, lang, source, {dna_sql('text')} AS dna FROM documents"

#: Recognition sites of common restriction enzymes and promoter boxes.
MOTIFS = {
    "EcoRI": "GAATTC", "BamHI": "GGATCC", "HindIII": "AAGCTT", "NotI": "GCGGCCGC", "XhoI": "CTCGAG", "PstI": "CTGCAG",
    "SalI": "GTCGAC", "SmaI": "CCCGGG", "KpnI": "GGTACC", "TATA": "TATAAA", "minus10": "TATAAT", "minus35": "TTGACA",
}


def dna(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", "lang", "source", S.bytes_to_dna("text").alias("dna"))


def strands(spark, sf, nt: int = 256):
    """Strands of ``nt`` bases of every document: doc_id, lang, i, s."""
    return dna(spark, sf).select("doc_id", "lang", F.posexplode(S.chunks("dna", nt)).alias("i", "s"))


STRANDS = f"SELECT doc_id, lang, unnest(range(len(c))) AS i, unnest(c) AS s FROM (SELECT doc_id, lang, regexp_extract_all(dna, '.{{1,256}}') AS c FROM ({DNA}))"


@query("seq_direct_map", f"SELECT doc_id, length(dna) AS n_bases, md5(dna) AS digest FROM ({DNA})")
def seq_direct_map(spark, sf):
    return dna(spark, sf).select("doc_id", F.length("dna").cast("long").alias("n_bases"), F.md5(F.col("dna").cast("binary")).alias("digest"))


@query("seq_round_trip", "SELECT doc_id, true AS same FROM documents")
def seq_round_trip(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", (S.dna_to_bytes(S.bytes_to_dna("text")) == F.col("text").cast("binary")).alias("same"))


@query(
    "seq_gc_by_lang",
    f"""SELECT lang, count(*) AS n_docs, CAST(sum(length(dna)) AS BIGINT) AS n_bases, round(avg({gc_sql('dna')}), 6) AS mean_gc,
    CAST(max({hp_sql('dna')}) AS INT) AS longest_run FROM ({DNA}) GROUP BY lang""",
)
def seq_gc_by_lang(spark, sf):
    return dna(spark, sf).groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum(F.length("dna")).alias("n_bases"),
        F.round(F.avg(S.gc_content("dna")), 6).alias("mean_gc"),
        F.max(S.max_homopolymer("dna")).alias("longest_run"),
    )


@query("seq_homopolymer", f"SELECT doc_id, {hp_sql('dna')} AS longest, len(regexp_extract_all(dna, 'A{{3,}}|C{{3,}}|G{{3,}}|T{{3,}}')) AS runs3 FROM ({DNA})")
def seq_homopolymer(spark, sf):
    return dna(spark, sf).select("doc_id", S.max_homopolymer("dna").cast("long").alias("longest"), S.count_homopolymers("dna").cast("long").alias("runs3"))


@query(
    "seq_constraints_filter",
    f"""SELECT doc_id, count(*) AS n_strands, count(*) FILTER ({gc_sql('s')} BETWEEN 0.4 AND 0.6 AND {hp_sql('s')} <= 3) AS n_ok,
    min({gc_sql('s')}) AS gc_min, max({gc_sql('s')}) AS gc_max FROM ({STRANDS}) GROUP BY doc_id""",
)
def seq_constraints_filter(spark, sf):
    return strands(spark, sf).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_strands"),
        F.count(F.when(S.constraint_ok("s"), 1)).alias("n_ok"),
        F.min(S.gc_content("s")).alias("gc_min"),
        F.max(S.gc_content("s")).alias("gc_max"),
    )


@query("seq_revcomp", f"SELECT doc_id, md5(reverse(translate(dna, 'ACGT', 'TGCA'))) AS digest FROM ({DNA})")
def seq_revcomp(spark, sf):
    return dna(spark, sf).select("doc_id", F.md5(S.reverse_complement("dna").cast("binary")).alias("digest"))


@query("seq_packed_complement", f"SELECT doc_id, md5(translate(dna, 'ACGT', 'TGCA')) AS digest FROM ({DNA})")
def seq_packed_complement(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.md5(S.bytes_to_dna(S.complement_bytes("text")).cast("binary")).alias("digest"))


@query("seq_yinyang", f"SELECT doc_id, md5({dna_sql('text', YIN_YANG)}) AS digest, true AS reversible FROM documents")
def seq_yinyang(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", S.yin_yang("text").alias("y"), S.bytes_to_dna("text").alias("d"))
    return docs.select("doc_id", F.md5(F.col("y").cast("binary")).alias("digest"), (S.yin_yang_inverse("y") == F.col("d")).alias("reversible"))


@query(
    "seq_gc_windows",
    f"""SELECT doc_id, i, count(*) AS n_windows, round(min({gc_sql('w')}), 6) AS low, round(max({gc_sql('w')}), 6) AS high
    FROM (SELECT doc_id, i, substr(s, CAST(unnest(range(1, length(s) - 18, 10)) AS BIGINT), 20) AS w FROM ({STRANDS}) WHERE length(s) >= 20) GROUP BY doc_id, i""",
)
def seq_gc_windows(spark, sf):
    w = strands(spark, sf).select("doc_id", "i", F.explode(S.windows("s", 20, 10)).alias("w"))
    return w.groupBy("doc_id", "i").agg(F.count(F.lit(1)).alias("n_windows"), F.round(F.min(S.gc_content("w")), 6).alias("low"), F.round(F.max(S.gc_content("w")), 6).alias("high")).withColumn("i", F.col("i").cast("long"))


@query("seq_gquad", f"SELECT doc_id, len(regexp_extract_all(dna, 'G{{3,}}.{{1,7}}G{{3,}}.{{1,7}}G{{3,}}.{{1,7}}G{{3,}}')) AS n FROM ({DNA})")
def seq_gquad(spark, sf):
    return dna(spark, sf).select("doc_id", S.g_quadruplexes("dna").cast("long").alias("n"))


_COUNTS = " UNION ALL ".join(f"SELECT '{k}' AS motif, CAST(sum((length(dna) - length(replace(dna, '{v}', ''))) // {len(v)}) AS BIGINT) AS n FROM d" for k, v in MOTIFS.items())


@query("seq_motifs", f"WITH d AS ({DNA}) {_COUNTS}")
def seq_motifs(spark, sf):
    counts = dna(spark, sf).agg(*[F.sum(S.occurrences("dna", v)).alias(k) for k, v in MOTIFS.items()])
    return counts.unpivot([], list(MOTIFS), "motif", "n")


@query(
    "seq_entropy",
    """WITH b AS (SELECT doc_id, b, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS b FROM documents) GROUP BY doc_id, b),
    t AS (SELECT doc_id, sum(n) AS total FROM b GROUP BY doc_id)
    SELECT doc_id, round(-sum(n / total * log2(n / total)), 6) AS bits FROM b JOIN t USING (doc_id) GROUP BY doc_id""",
)
def seq_entropy(spark, sf):
    pairs = F.regexp_extract_all(F.hex(F.col("text").cast("binary")), F.lit("(..)"), F.lit(1))
    b = table(spark, sf, "documents").select("doc_id", F.explode(pairs).alias("b")).groupBy("doc_id", "b").agg(F.count(F.lit(1)).alias("n"))
    # H = log2(total) - sum(n log2 n) / total needs no second pass over the totals
    return b.groupBy("doc_id").agg(F.round(F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n"), 6).alias("bits"))


@query(
    "seq_is_dna",
    r"""SELECT 'documents' AS t, count(*) FILTER (b >= 16 AND 2 * b >= n) AS dna_like, count(*) AS total FROM
    (SELECT length(x) - length(translate(x, 'ACGT', '')) AS b, length(x) AS n FROM (SELECT upper(regexp_replace(regexp_replace(text, '(?m)^>[^\n]*$', '', 'g'), '\s', '', 'g')) AS x FROM documents))
    UNION ALL SELECT 'strands', count(*), count(*) FROM documents WHERE length(text) >= 4""",
)
def seq_is_dna(spark, sf):
    docs = table(spark, sf, "documents").where(F.col("text").isNotNull())
    a = docs.select(F.lit("documents").alias("t"), S.is_dna_like("text").alias("d"))
    b = dna(spark, sf).join(docs.where(F.length("text") >= 4).select("doc_id"), "doc_id", "left_semi").select(F.lit("strands").alias("t"), S.is_dna_like("dna").alias("d"))
    return a.unionByName(b).groupBy("t").agg(F.count(F.when(F.col("d"), 1)).alias("dna_like"), F.count(F.lit(1)).alias("total"))


@query(
    "input_type",
    r"""WITH x AS (SELECT text AS t FROM documents UNION ALL SELECT html FROM pages UNION ALL SELECT '>read ' || item_id || chr(10) || text FROM benchmark)
    SELECT CASE WHEN starts_with(t, '>') OR regexp_matches(t, '^@[^\n]*\n[ACGTN]') THEN 'biological' ELSE 'general' END AS kind, count(*) AS n FROM x WHERE t IS NOT NULL GROUP BY 1""",
)
def input_type(spark, sf):
    x = table(spark, sf, "documents").select(F.col("text").alias("t")).unionAll(table(spark, sf, "pages").select("html"))
    x = x.unionAll(table(spark, sf, "benchmark").select(F.concat(F.lit(">read "), F.col("item_id").cast("string"), F.lit("\n"), F.col("text"))))
    return x.where("t is not null").groupBy(S.input_kind("t").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "seq_hamming_neighbours",
    f"""SELECT item_id, i, CAST(len(list_filter(range(1, least(length(s), length(n)) + 1), lambda k: s[k] <> n[k])) + abs(length(s) - length(n)) AS INT) AS distance
    FROM (SELECT item_id, i, s, lead(s) OVER (PARTITION BY item_id ORDER BY i) AS n
      FROM (SELECT item_id, CAST(unnest(range(len(c))) AS INT) AS i, unnest(c) AS s FROM (SELECT item_id, regexp_extract_all({dna_sql('text')}, '.{{1,64}}') AS c FROM benchmark)))
    WHERE n IS NOT NULL""",
)
def seq_hamming_neighbours(spark, sf):
    """Distance between each strand of a benchmark text and the next one."""
    b = table(spark, sf, "benchmark").select("item_id", F.posexplode(S.chunks(S.bytes_to_dna("text"), 64)).alias("i", "s"))
    after = b.select("item_id", (F.col("i") - 1).alias("i"), F.col("s").alias("next"))
    return b.join(after, ["item_id", "i"]).select("item_id", "i", S.hamming("s", "next").alias("distance"))


@query("seq_primer_tm", f"SELECT doc_id, i, 2 * length(s) + 2 * (length(s) - length(translate(s, 'GC', ''))) AS tm FROM ({STRANDS})")
def seq_primer_tm(spark, sf):
    return strands(spark, sf).select("doc_id", F.col("i").cast("long").alias("i"), S.melting_wallace("s").cast("long").alias("tm"))


@query("page_uri_parts", r"SELECT page_id, regexp_extract(u, '^dna://([^/]+)/?(.*)$', 1) AS pool, regexp_extract(u, '^dna://([^/]+)/?(.*)$', 2) AS key FROM (SELECT page_id, regexp_replace(url, '^https?', 'dna') AS u FROM pages)")
def page_uri_parts(spark, sf):
    p = table(spark, sf, "pages").select("page_id", S.dna_uri(F.regexp_replace("url", "^https?", "dna")).alias("u"))
    return p.select("page_id", "u.pool", "u.key")
