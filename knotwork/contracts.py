"""What can be put in from outside: the shapes of embedders, extractors, model clients and stores.

Nothing here is needed at run time; any object with these methods will do. Objects that reach tasks (an embedder's
column, an extractor) are sent by value, so clients should open their connections on first use.
"""

from __future__ import annotations

from typing import Any, Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame


@runtime_checkable
class Embedder(Protocol):
    """Texts to vectors of ``dims`` values: one on the driver, a column in the cluster."""

    dims: int

    def embed(self, text: str) -> list[float]: ...

    def column(self, text: Column | str) -> Column: ...


@runtime_checkable
class EmbeddingClient(Protocol):
    """A model service for embeddings."""

    def embed(self, texts: list[str]) -> list[list[float]]: ...


@runtime_checkable
class ChatClient(Protocol):
    """A model service for chat: an answer to messages of ``role`` and ``content``."""

    def chat(self, messages: list[dict[str, str]], **options: Any) -> str: ...


@runtime_checkable
class ExtractionClient(Protocol):
    """A model service that reads nodes and edges off a text."""

    def extract(self, text: str) -> dict[str, list[dict[str, Any]]]: ...


@runtime_checkable
class TableStore(Protocol):
    """Named tables that are read as DataFrames and committed together."""

    def initialize(self) -> None: ...

    def read(self, name: str) -> DataFrame: ...

    def commit(self, **tables: DataFrame) -> None: ...

    def append(self, **tables: DataFrame) -> None: ...

    def vacuum(self) -> int: ...
