import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

from vintagebook.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session


def documents(spark, rows):
    """Rows (doc_id, text, lang, source) as documents, with extra columns whose names clash with working names."""
    data = [(i, t, lang, s, None if t is None else len(t), "x", 1.5, "h") for i, t, lang, s in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, key string, score double, hash string")
