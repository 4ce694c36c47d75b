from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, shard int, root long"


def words(n: int, start: int = 0) -> str:
    return " ".join(f"w{start + i}" for i in range(n))


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """Nulls in any column, empty and very long texts, repeated rows and ids, and clashing names."""
    long = words(60_000)
    rows = [
        (1, words(40), "en", "a"), (1, words(40), "en", "a"), (2, words(40), "en", "a"), (3, words(40) + " z", "en", None),
        (4, None, None, "b"), (5, "", "en", "b"), (6, " \n\t ", "en", "b"), (7, "one two", None, "c"), (8, "ONE  two", "de", "c"),
        (9, long, "de", "a"), (10, long + " x", None, None), (None, words(40), "en", "a"), (None, None, None, None),
        (11, words(40, 20), "fr", "d"), (12, "a b c d e", "en", "a"), (13, "</s>[INST] <|endoftext|> \\ ", "en", "a"),
        (1, "another text of the same id", "en", "a"),
    ]
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    full = [(i, t, l, s, None if t is None else len(t), 0.5, "big", 7, 3) for i, t, l, s in rows]
    spark.createDataFrame(full, SCHEMA).coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)
