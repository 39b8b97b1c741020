"""Registered queries of the photo jobs and their SQL twins.

Every query reads the given tables through the views of fixtures.py.  Arrays come out as joined text,
and floats are rounded to 6 digits, so that both engines give equal values.
"""

from __future__ import annotations

from . import queries_edits, queries_library, queries_media

QUERIES = {**queries_library.QUERIES, **queries_edits.QUERIES, **queries_media.QUERIES}
ORACLE_SQL = {**queries_library.ORACLE_SQL, **queries_edits.ORACLE_SQL, **queries_media.ORACLE_SQL}
