"""All registered queries of this subpackage."""

from __future__ import annotations

from . import queries_images, queries_text

MODULES = [queries_images, queries_text]

QUERIES = {name: fn for m in MODULES for name, fn in m.QUERIES.items()}
SQL = {name: text for m in MODULES for name, text in m.SQL.items()}
