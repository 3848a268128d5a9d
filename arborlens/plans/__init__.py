"""Graph projections of the driver's tables and the registered queries."""
