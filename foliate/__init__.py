"""Analytics over collections of text documents, as PySpark DataFrame functions."""
