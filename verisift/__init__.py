"""verisift: evidence analytics on PySpark."""
