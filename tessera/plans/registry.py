"""All registered queries outside the training-data subpackage."""

from __future__ import annotations

from . import claims, documents, evaluation, groups, provenance, reports, selection

MODULES = [documents, provenance, evaluation, groups, selection, reports, claims]

QUERIES = {name: fn for m in MODULES for name, fn in m.QUERIES.items()}
SQL = {name: text for m in MODULES for name, text in m.SQL.items()}
