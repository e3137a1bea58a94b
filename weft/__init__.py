"""weft: a Spark-native engine for document-translation data.

Operators are DataFrame-to-DataFrame functions.  ``functions`` holds column expressions and
the few Arrow UDFs, ``operators`` the relational building blocks, ``plans`` the named queries,
``sources`` and ``streaming`` the edges.
"""
