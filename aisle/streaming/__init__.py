"""The row-wise part of catalogue preparation on a streaming DataFrame."""
