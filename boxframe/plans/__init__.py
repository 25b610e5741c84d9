"""Views over the test tables and the registry of queries with their SQL."""
