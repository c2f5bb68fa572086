"""Sketch analytics on PySpark: hash sketches as long tables, searched and decomposed with DataFrame joins."""
