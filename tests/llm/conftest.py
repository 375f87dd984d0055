import pytest

pytest.importorskip("mhqa.llm")
