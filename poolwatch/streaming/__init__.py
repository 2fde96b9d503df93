"""Streaming jobs, their state processors, and how to run them."""
