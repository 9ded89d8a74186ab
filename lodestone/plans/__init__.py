"""Named queries: importing this package fills the catalogue."""

from . import catalog, catalog_books, catalog_commits, catalog_exchange, catalog_imports, catalog_more, catalog_rest  # noqa: F401
from .catalog import ORACLES, QUERIES  # noqa: F401
