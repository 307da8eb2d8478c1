"""Registered queries of the document operators, and their DuckDB equivalents."""

from protolake.queries import entities, extension, extract, standards, text

QUERIES = {**text.QUERIES, **extract.QUERIES, **entities.QUERIES, **standards.QUERIES, **extension.QUERIES}
ORACLES = {**text.ORACLES, **extract.ORACLES, **entities.ORACLES, **standards.ORACLES, **extension.ORACLES}
