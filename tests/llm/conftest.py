import pytest

from gradeweave.llm.common import prepare

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session", autouse=True)
def prepared(spark):
    prepare(spark)


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts, or from (doc_id, text) pairs."""

    def build(texts, extra=""):
        pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        rows = [(i, t, "en", "s", len(t or "")) for i, t in pairs]
        return spark.createDataFrame([r + ("x",) * bool(extra) for r in rows], DOCS + (f", {extra} string" if extra else ""))

    return build
