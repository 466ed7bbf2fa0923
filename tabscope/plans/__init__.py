"""Questions answered by several operators together, and the batch job."""
