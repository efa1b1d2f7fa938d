"""Reports composed from the operators, the sales model, the query catalog and its oracle."""
