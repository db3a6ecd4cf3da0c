"""The executors' Python workers need the package."""

import pytest


@pytest.fixture(autouse=True, scope="session")
def shipped(spark):
    from factweave.llm.store import ship_package

    ship_package(spark)
