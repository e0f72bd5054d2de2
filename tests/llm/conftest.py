import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, doc string, kept string, score double, copy int, _n int, row int, part int, place bigint"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with columns named like some that operators use or return."""
    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), "x", "y", 9.0, 7, 1, 2, 3, 4) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty and white texts, a long one, repeated rows, repeated ids, ties."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
    return [(3, "one two three four"), (1, None), (2, ""), (4, " \t\n "), (5, long), (6, "a"), (7, "one two three four"), (7, "one two three four"),
            (8, "same id"), (8, "other text of the id"), (None, "no id at all"), (None, None), (9, "É ß 漢字 😀 naïve"), (10, long)]
