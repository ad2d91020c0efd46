"""Registered queries: one per operator row of the inventory.

Each query reads the driver tables of one scale directory (or data Spark
derives from them) and has, where SQL can express it, an equivalent DuckDB
statement over the same tables.  Importing this package fills ``REGISTRY``.
"""

from nearline.plans.registry import REGISTRY, register  # noqa: F401
from nearline.plans import q_search, q_sources, q_text, q_sampling, q_lexical, q_losses, q_tokens, q_encode, q_ann, q_streaming  # noqa: F401,E402
