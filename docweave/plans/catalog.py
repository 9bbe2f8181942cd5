"""All registered queries: importing the modules registers them."""

from __future__ import annotations

from . import graphs, pages, queues, records, search  # noqa: F401
from .queries import ORACLE_SQL, QUERIES  # noqa: F401
