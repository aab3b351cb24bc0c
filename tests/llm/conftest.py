import pytest


@pytest.fixture(scope="session")
def shared(spark, tmp_path_factory):
    """A session that names its shared folder."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    return spark


@pytest.fixture(scope="session")
def odd(shared):
    """Nulls in every column, empty, blank, short and very long texts, repeated rows and ids, extra columns with clashing names."""
    prose = " ".join(f"word{i % 97} item{i % 89} thing{i % 83}" for i in range(400))
    rows = [(1, prose), (2, prose), (2, prose), (2, "another text under the same id, mail bob@example.org now"), (3, None), (4, ""), (5, " \n\t "), (None, prose + " end"), (None, None),
            (6, "ab"), (7, "x" * 30000), (8, prose.upper()), (9, "Ünïcödé ☃ text 日本語 " * 40), (10, prose + " tail of near copy"), (11, "+1 (555) 123-4567 and 4111 1111 1111 1111 at 10.0.0.1")]
    rows = [(i, t, None if i == 1 else "en", None, None, t, 0, i) for i, t in rows]
    return shared.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words long, node long")
