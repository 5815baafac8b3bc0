"""All queries by name, and the SQL each is compared with."""

from glyphflow.plans import changes, formats, lexicon, library, listening, reading, texts

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _part in (texts, library, lexicon, changes, listening, reading, formats):
    QUERIES |= _part.QUERIES
    SQL |= _part.SQL
