"""Known cases of operators, each with its rows and the rows expected inline."""

import duckdb
import pytest

from tests.cases.model_cases import MODEL_CASES
from tests.cases.sequence_cases import CASES
from tests.cases.tag_cases import TAG_CASES
from tests.test_oracles import rows

EVERY = {name: (query, part.oracles[name]) for part in (MODEL_CASES, TAG_CASES, CASES) for name, query in part.queries.items()}


@pytest.mark.parametrize("name", list(EVERY))
def test_case(spark, name):
    query, sql = EVERY[name]
    df = query(spark, "")
    want = duckdb.connect().execute(sql)
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, want.fetchall())
