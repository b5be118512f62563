"""Analytics jobs written as plain DataFrame code, for trackers, run records, catalogues and logs."""
