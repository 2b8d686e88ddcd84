"""Training-data operators: each module holds one operator and its docstring states the edge cases."""
