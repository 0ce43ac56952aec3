import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts, or from (doc_id, text, lang, source) rows, with a clashing extra column or two."""
    from pyspark.sql import functions as F

    from sequora.session import ship

    ship(spark)

    def build(rows, extra: bool = False):
        full = [r if isinstance(r, tuple) else (i, r, "en", "a") for i, r in enumerate(rows)]
        df = spark.createDataFrame([(*r, len(r[1] or "")) for r in full], SCHEMA)
        if extra:
            for name in ("t", "o", "r", "key", "h", "norm", "n", "fp", "cell", "start", "size", "bucket", "kept", "__sha"):
                df = df.withColumn(name, F.lit(7))
        return df

    return build


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


@pytest.fixture(scope="session")
def prose():
    """A seeded text of n words."""
    import random

    return lambda n, seed: " ".join(random.Random(seed).choices(WORDS, k=n))


@pytest.fixture(scope="session")
def odd(prose):
    """Null, empty, blank, tiny, repeated, non-Latin and long texts."""
    return [None, "", " \t\n ", "x", "x ", "x", "a b", prose(60, 1), prose(60, 1), prose(3000, 2), prose(60, 1).upper(), "日本語 テキスト é́ \x1c\x85 𝔘", "\x00 nul"]
