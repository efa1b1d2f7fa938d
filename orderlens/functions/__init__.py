"""Column expressions shared by the metrics (money, growth, floor days, buckets, labels)."""
