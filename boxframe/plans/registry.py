"""All queries over the test tables, and their SQL."""

from __future__ import annotations

from boxframe.plans import augmentation, evaluation, files, pictures, sequences, targets

PARTS = (evaluation, sequences, targets, augmentation, pictures, files)
QUERIES = {name: query for part in PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in PARTS for name, sql in part.ORACLE_SQL.items()}
FLAGSHIP = "eval_exact_overall_deduplicated"
