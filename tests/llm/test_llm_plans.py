"""The operators that must do without Python do."""

import pytest
from conftest import DATA

from cairn.llm import exact_dedup, mixing
from cairn.llm.common import read


@pytest.mark.parametrize("make", [lambda d: exact_dedup.exact_groups(d), lambda d: exact_dedup.recipes(exact_dedup.chunk_rows(d)), lambda d: mixing.mix(d)])
def test_no_python(spark, make):
    p = make(read(spark, DATA, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in p for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))
