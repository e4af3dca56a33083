"""Filter expressions and metrics, compiled to Columns."""
