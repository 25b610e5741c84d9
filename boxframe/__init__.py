"""boxframe: Spark DataFrame operators for structured diagram extraction data."""
