"""foliospark: analytics, search and recommendation operators for article libraries on PySpark."""
