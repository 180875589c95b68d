import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

LONG = "long " * 3000 + "".join(f"w{k} " for k in range(4000))
TEXTS = [
    None, "", "   \n\t", "one", "one", "a b c d e f", "Ünïcode “text”  with spaces 漢字テキスト 123 'll 's", LONG, LONG + "tail",
    *["the quick brown fox jumps over the lazy dog and runs far away into the deep dark green forest near hill number seven"] * 3,
    "the quick brown fox jumps over the lazy dog and runs far away into the deep dark green forest near hill number eight",
    "intro words here then the quick brown fox jumps over the lazy dog and runs far away into the deep dark green forest near and an end",
    "###!! $$$ %% ~~ <|endoftext|> x", "line one\nline one\nline two\n\nline one", "ab" * 400, "ab" * 400 + "c", "same same same same same same same same same same same",
]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, copies, a repeated row, a null id, and columns whose names clash with inner ones."""
    rows = [(k * 3 % 41, t) for k, t in enumerate(TEXTS)] + [(27, TEXTS[9]), (None, TEXTS[9]), (None, None)]
    return spark.createDataFrame([(i, t, "x", "en", 1, b"z", 2) for i, t in rows], "doc_id long, text string, source string, lang string, id int, blob binary, g int").repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)


