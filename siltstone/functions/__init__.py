"""Column builders: text, vectors and scores. None of them is a Python UDF unless its docstring says so."""
