import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with the columns of the table, and two extra columns with names that operators use themselves."""
    def make(texts, ids=None, lang="en", source="src1"):
        ids = list(range(len(texts))) if ids is None else ids
        langs = lang if isinstance(lang, list) else [lang] * len(texts)
        sources = source if isinstance(source, list) else [source] * len(texts)
        rows = [(i, t, a, s, None if t is None else len(t), "x", 7) for i, t, a, s in zip(ids, texts, langs, sources)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, id long").repartition(3)
    return make
