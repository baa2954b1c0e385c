import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def documents(spark):
    """A table of documents from ``(id, text)`` or ``(id, text, source)`` rows."""

    def make(rows, extra=False):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCUMENTS)
        if extra:  # names that the operators use inside
            for name in ("id", "set", "key", "label", "score", "line", "site", "part", "block", "ids"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return make
