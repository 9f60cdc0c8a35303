from __future__ import annotations

import pytest

from tidebook.llm.common import Scratch


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")


@pytest.fixture
def docs_of(spark):
    """Documents with an extra column and a name that operators also use inside."""

    def make(texts, ids=None, source="s"):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, "en", source, None if t is None else len(t), 7, "x") for i, t in zip(ids, texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, first long, root string")

    return make
