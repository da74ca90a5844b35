"""Recall of the secret models through the whole scan, letter-only keys included."""

import random
import string

from mediaops.llm import secrets

SF = "/root/testdata/sf0.001"


def test_tokens_of_letters_are_judged(spark):
    models = secrets.default_models(spark, secrets.ordinary_strings(spark.read.parquet(f"{SF}/benchmark.parquet")))
    draw = random.Random(41)
    for letters in (string.ascii_letters, string.ascii_lowercase, string.ascii_uppercase):
        tokens = ["".join(draw.choices(letters, k=k)) for k in (16, 20, 24, 32) for _ in range(100)]
        found = sum(secrets.spans_of(f"see {t} here", models) == [(4, "markov", 4 + len(t))] for t in tokens)
        assert found > 0.85 * len(tokens), (letters, found)
    ordinary = ["internationalization", "Donaudampfschifffahrtsgesellschaft", "anticonstitutionnellement", "electroencefalografistas", "1234567890123456",
                "getUserAuthenticationTokenFromRequest", "MAX_CONNECTION_RETRY_COUNT", "usr/local/share/applications", "state-of-the-art-technology",
                "AbstractSingletonProxyFactoryBean", "-" * 40, "_" * 40, "=" * 40, "AB" * 12, "_____name_of_the_author_____", "-----documentation-----"]
    assert [t for t in ordinary if secrets.spans_of(t, models)] == []
