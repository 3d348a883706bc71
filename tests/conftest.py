import pytest

from quire.session import build_session


@pytest.fixture(scope="session")
def spark():
    return build_session("8", "tests")


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"
