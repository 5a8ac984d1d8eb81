"""All core queries by name, and their SQL."""

from millrace.catalog import epochs, events, flows, problems, rows, streams, surface

_ALL = (problems, rows, flows, epochs, events, streams, surface)
QUERIES = {name: query for module in _ALL for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in _ALL for name, sql in module.ORACLE.items()}
