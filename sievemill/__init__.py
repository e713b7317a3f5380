"""Web-page extraction and corpus processing on PySpark."""
