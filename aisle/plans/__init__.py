"""Jobs that chain operators: index builds, end-to-end preparation, benchmarks."""
