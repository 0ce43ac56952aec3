"""Strand addresses: reads are assigned to the strand whose address theirs is, or nearly is.

An address is a 24-bit strand number and a seed byte, XORed with four fixed bytes and written
as 16 bases. Packed into a long, two bits a base, changing one base is one XOR, so the
addresses within a base of another are 48 XORs away and a tolerant join stays an equi-join.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settled

BASES = 16
#: The bytes that an address is XORed with.
WHITENING = (0x1B, 0x4B, 0x24, 0x6D)
_WHITE = int.from_bytes(bytes(WHITENING), "big")


def address_code(strand: Column, seed: Column | None = None) -> Column:
    """The packed address of a strand number, as written (whitened)."""
    raw = F.shiftleft(strand.cast("long"), 8).bitwiseOR((F.lit(0) if seed is None else seed).cast("long"))
    return raw.bitwiseXOR(F.lit(_WHITE))


def address_dna(code: Column) -> Column:
    four = F.array(*[F.lit("".join(letters)) for letters in product("ACGT", repeat=4)])
    return F.concat(*[F.get(four, F.shiftright(code, shift).bitwiseAND(F.lit(255)).cast("int")) for shift in (24, 16, 8, 0)])


def read_code(dna: Column) -> Column:
    """The packed address that a read begins with; null if it is short or has another letter."""
    head = F.substring(dna, 1, BASES)
    return F.when(head.rlike(f"^[ACGT]{{{BASES}}}$"), F.conv(F.translate(head, "ACGT", "0123"), 4, 10).cast("long"))


def strand_of(code: Column) -> Column:
    return F.shiftright(code.bitwiseXOR(F.lit(_WHITE)), 8)


def seed_of(code: Column) -> Column:
    return code.bitwiseXOR(F.lit(_WHITE)).bitwiseAND(F.lit(255))


def changed_bases(a: Column, b: Column) -> Column:
    """Bases in which two packed addresses differ."""
    bits = a.bitwiseXOR(b)
    return F.bit_count(bits.bitwiseOR(F.shiftright(bits, 1)).bitwiseAND(F.lit(0x55555555)))


def in_range(code: Column, strands: int, seeds: int = 1) -> Column:
    """Whether an address names one of ``strands`` strands under one of ``seeds`` seeds."""
    return (strand_of(code) < strands) & (seed_of(code) < seeds)


def _around(rows: DataFrame, code: str, key: str, places: list[int]) -> DataFrame:
    """A row for each address one base from ``code`` in one of ``places``, in column ``key``."""
    changes = [change << 2 * place for place in places for change in (1, 2, 3)]
    return rows.withColumn(key, F.explode(F.array(*[F.lit(c).cast("long") for c in changes]).cast("array<long>"))).withColumn(key, F.col(code).bitwiseXOR(F.col(key)))


def _without(rows: DataFrame, code: str, key: str, places: list[int]) -> DataFrame:
    """A row for each of ``places``: ``code`` without that base, and (in the high bits) which it is."""
    without = [F.col(code).bitwiseAND(F.lit(~(3 << 2 * place))).bitwiseXOR(F.lit(place << 58)) for place in places]
    return rows.withColumn(key, F.explode(F.array(*without).cast("array<long>")))


def _common(least: DataFrame) -> tuple[int, int]:
    """Which bits of an address belong to bases that all of ``least`` (code) have alike, and these bits; all and 0 of none."""
    both, one = least.agg(F.expr("bit_and(code)"), F.expr("bit_or(code)")).first()
    alike = sum(3 << 2 * place for place in range(BASES) if both is None or not (both ^ one) >> 2 * place & 3)
    return alike, (both or 0) & alike


def nearest(codes: DataFrame, references: DataFrame, most: int = 2) -> DataFrame:
    """(code, strand, changed) of the ``codes`` (column code) within ``most`` bases of a reference (strand, code).

    The nearest reference is taken, and of equally near ones the least strand number. Bases that
    all references have alike (seeds, leading digits) are set right first, each a change, so
    many codes become one, and only the other bases are looked around in. Waves: equal addresses
    are one equi-join; what is left meets the references without one base, a row for each base;
    what is still left and the references meet half-way, under the addresses one base around
    each of both, which two addresses share exactly when they are two bases apart or less.
    """
    if not 0 <= most <= 2:
        raise ValueError("neighbourhoods meet half-way up to two changed bases")
    least = settled(references.where("code is not null").groupBy("code").agg(F.min("strand").alias("strand")))
    alike, bits = _common(least)
    places = [place for place in range(BASES) if not alike >> 2 * place & 3]
    right = F.col("code").bitwiseAND(F.lit(~alike)).bitwiseOR(F.lit(bits))
    distinct = settled(codes.select("code").distinct()).where("code is not null")  # stored in between: a filter pushed down works codes out twice
    every = settled(distinct.select("code", right.alias("right"), changed_bases(F.col("code"), right).alias("wrong")).where(F.col("wrong") <= most))
    left = settled(every.groupBy(F.col("right").alias("code")).agg(F.min("wrong").alias("wrong")))
    waves = [settled(left.join(least, "code").select("code", "strand", F.lit(0).alias("more")))]
    for more in range(1, most + 1):
        left = settled(left.join(waves[-1].select("code"), "code", "left_anti").where(F.col("wrong") <= most - more))
        meet = _without if more == 1 else _around
        known = meet(least, "code", "key", places).groupBy("key").agg(F.min("strand").alias("strand"))
        # told to merge: the planner does not see that rows are multiplied, and would broadcast what looks small
        waves.append(settled(meet(left.select("code"), "code", "key", places).join(known.hint("merge"), "key").groupBy("code").agg(F.min("strand").alias("strand")).withColumn("more", F.lit(more))))
    found = waves[0]
    for wave in waves[1:]:
        found = found.unionByName(wave)
    near = every.join(found.withColumnRenamed("code", "right"), "right").select("code", "strand", (F.col("wrong") + F.col("more")).alias("changed"))
    return settled(near.where(F.col("changed") <= most))


def by_address(reads: DataFrame, sequence: str, references: DataFrame, most: int = 2) -> DataFrame:
    """``reads`` with strand, changed and outcome: exact, near, unknown (no reference is near) or unreadable.

    Addresses are settled once each, however many reads carry one; a crowded address is a crowded
    key on the reads' side only, which adaptive execution splits.
    """
    coded = reads.withColumn("code", read_code(F.col(sequence)))
    found = nearest(coded, references, most)
    outcome = F.when(F.col("changed") == 0, "exact").when(F.col("changed") > 0, "near").otherwise("unknown")
    # unreadable reads have keys of their own, spread over the tasks, that no code equals
    key = F.coalesce("code", F.lit(-1) - F.pmod(F.monotonically_increasing_id(), F.lit(9973)))
    joined = coded.withColumn("__key", key).join(found.withColumnRenamed("code", "__key"), "__key", "left")
    return joined.withColumn("outcome", F.when(F.col("code").isNull(), "unreadable").otherwise(outcome)).select(*reads.columns, "strand", "changed", "outcome")


def clusters(assigned: DataFrame) -> DataFrame:
    """(strand, reads, near, discarded): a row a strand; reads without one are counted in the row of strand null."""
    kept = F.col("strand").isNotNull()
    return assigned.groupBy("strand").agg(
        F.count(F.when(kept, 1)).alias("reads"), F.count(F.when(F.col("outcome") == "near", 1)).alias("near"), F.count(F.when(~kept, 1)).alias("discarded")
    )


def derived_address(payload: Column, size: int = 16) -> Column:
    """The address that a payload has by its content: the first ``size`` bytes of its SHA-256, in hex."""
    return F.substring(F.sha2(payload.cast("binary"), 256), 1, 2 * size)


def address_erasures(payloads: DataFrame, addresses: DataFrame, known: DataFrame, size: int = 16) -> DataFrame:
    """(strand, reason): strands whose data cannot be trusted, each once.

    ``payloads`` (strand, payload) are recomputed and compared with ``addresses`` (strand,
    address): one that differs is ``changed``; an address without a payload is ``missing``; a
    payload without an address is trusted. ``known`` (strand) are erasures from before.
    """
    own = payloads.select("strand", derived_address(F.col("payload"), size).alias("derived"), F.lit(True).alias("there"))
    both = addresses.select("strand", "address").join(own, "strand", "left")
    reason = F.when(F.col("there").isNull(), "missing").when(~F.col("derived").eqNullSafe(F.col("address")), "changed")
    found = both.select("strand", reason.alias("reason")).where("reason is not null")
    order = F.when(F.col("reason") == "known", 0).when(F.col("reason") == "missing", 1).otherwise(2)
    return found.unionByName(known.select("strand", F.lit("known").alias("reason"))).groupBy("strand").agg(F.min_by("reason", order).alias("reason"))
