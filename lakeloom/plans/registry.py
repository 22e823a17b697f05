"""All registered queries of the library's own operators, with their SQL."""

from __future__ import annotations

from . import arrivals, commerce, documents, files, history, layouts, motorsport, music, quality, rides, scalars, streams, taxi  # noqa: F401
from .base import ORACLE_SQL, QUERIES  # noqa: F401
