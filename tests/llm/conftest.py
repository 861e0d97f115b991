import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

#: Columns whose names the operators use themselves.
CLASH = "n_words long, kept boolean, copies long, size long, component_id long, score double, target double, of string, other long, wanted long, node long, key long, removed string, copy long, __of long, __held_by long, __other long, __key long, `limit` int, stratum string"


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text[, lang[, source]]) with clashing extra columns."""

    def make(rows):
        full = [(*r, *[None] * (4 - len(r)), len(r[1]) if r[1] is not None else None, *[None] * (CLASH.count(',') + 1)) for r in rows]
        return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}")

    return make

