"""Training-data operators.

One module per operator; every module has a general operator (own column
names, own parameters) and the thin query that applies it to a whole table.
Nothing outside this subpackage imports it.
"""
