"""Graph operators over node and edge frames."""
