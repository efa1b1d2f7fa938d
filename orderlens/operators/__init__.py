"""Dataflow steps and metric functions: sales fact, revenue, product, geography,
customer experience, profiling and exact quantiles."""
