"""The registered queries: every operator over the driver's tables, with its SQL twin where there is one."""

from tracewell.queries import aggregating, clips, extra, judging, more, pictures, records, selecting, windowing

_MODULES = (windowing, selecting, aggregating, judging, extra, more, pictures, records, clips)
QUERIES = {name: run for module in _MODULES for name, run in module.BOOK.queries.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.BOOK.sql.items()}
