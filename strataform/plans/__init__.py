"""Named queries: each applies an operator to the carrier tables, with the same question as SQL beside it."""

from . import carriers_io, carriers_more
from .carriers import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "carriers_io", "carriers_more"]
