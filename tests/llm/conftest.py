import pytest

from millwatch.llm.common import prepare


@pytest.fixture(autouse=True)
def ready(spark):
    prepare(spark)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
