import pytest

from tidelog.llm import lm


@pytest.fixture(autouse=True)
def few_rounds(monkeypatch):
    """Two parts of the windows instead of eight: each is a job of its own."""
    monkeypatch.setattr(lm, "ROUNDS", 2)
