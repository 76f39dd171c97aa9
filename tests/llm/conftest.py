import pytest


@pytest.fixture(scope="session")
def vocabularies():
    from pathlib import Path

    from tidemark.llm.tokens import VOCABULARIES

    if not Path(VOCABULARIES).exists():
        pytest.skip("no vocabulary files here")
    return VOCABULARIES
