"""namesift: package-name hallucination analytics on PySpark."""
