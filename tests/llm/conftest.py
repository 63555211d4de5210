from tests.llm.tables import empty, folder  # noqa: F401
