"""Named queries over the driver's tables; importing this package registers them all."""

from . import directory, feeds, locations, pages, places, publication, records, scalars, streams, workflow  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
