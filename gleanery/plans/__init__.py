"""The library's queries: importing this package fills the catalogue."""

from . import label_queries, memory_queries, recall_queries, relational_queries, search_queries, text_queries  # noqa: F401
from .catalog import ORACLES, QUERIES  # noqa: F401
