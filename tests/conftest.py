import pytest

from tests import parity


@pytest.fixture(scope="session")
def spark():
    return parity.session()
