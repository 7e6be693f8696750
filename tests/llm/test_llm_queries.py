"""Every query of the subpackage against its SQL on the small tables."""

from __future__ import annotations

import pytest

from strandline.llm import registry

from ..compare import same
from ..conftest import DATA


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, tables, name):
    got = registry.QUERIES[name](spark, str(DATA)).toPandas()
    if name in registry.SQL:
        same(got, tables.execute(registry.SQL[name]).df())
    else:
        assert len(got.columns) > 0
