"""Log classification analytics on Spark: labelled log tables, vector retrieval, scoring and reports."""
