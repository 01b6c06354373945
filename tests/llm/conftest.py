import pytest


@pytest.fixture(scope="session")
def brute_words():
    import re

    return lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
