"""A tolerant HTML tree, selectors, URL resolution and Markdown rendering in plain Python (no Spark)."""
