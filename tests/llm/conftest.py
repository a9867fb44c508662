import pytest

pytest.importorskip("linkspark.llm")
