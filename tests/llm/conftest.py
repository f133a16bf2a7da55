import pytest


@pytest.fixture(scope="session")
def words():
    """A small vocabulary for made-up texts."""
    return "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


@pytest.fixture
def docs_of(spark):
    """A table of documents (doc_id, text) with further columns, some of whose names operators use themselves."""

    def build(rows, extra=True):
        if not extra:
            return spark.createDataFrame(rows, "doc_id long, text string")
        full = [(i, t, "en", "s", len(t) if t is not None else None, "x", 1) for i, t in rows]
        return spark.createDataFrame(
            full, "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, n int"
        )

    return build
