"""Training-data pipeline operators: each module holds one operator, its docstring states the defined results."""
