import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with everything that may be odd: nulls, empty and long texts, ties, repeated rows, clashing columns."""
    prose = " ".join(f"word{i % 97}x{i % 13}" for i in range(400))
    rows = [
        (1, "plain " + prose, "en", "a", 9, 1),
        (1, "plain " + prose, "en", "a", 9, 1),  # a repeated row
        (2, None, None, None, None, 2),
        (3, "", "en", "a", 0, 3),
        (4, " \n\t ", "en", None, 4, 4),
        (None, "no id " + prose, "de", "b", 5, 5),
        (5, "x" * 30_000, "de", "b", 6, 6),
        (6, "ab " * 40_000, "fr", "b", 7, 7),
        (8, "k" * 40_000 + " @ 1 " + "7" * 40_000 + " . " + "aB3/" * 20_000, "fr", "b", 8, 9),
        (7, prose + " Ünïcödé ▁ 😀 \x00 end", "fr", "c", 8, 8),
        (7, "another text of the same id", "fr", "c", 8, 8),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row_id long").selectExpr("*", "row_id AS row", "row_id AS key", "row_id AS size", "row_id AS rate", "row_id AS block", "row_id AS host", "row_id AS digest", "row_id AS label", "row_id AS id", "row_id AS spans", "row_id AS node", "row_id AS words", "row_id AS hash", "row_id AS `range`", "row_id AS __id", "row_id AS __key", "row_id AS __copy", "row_id AS __cut")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
