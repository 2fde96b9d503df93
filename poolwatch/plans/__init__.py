"""Jobs a user runs. Each takes tables of the whole fleet and returns one table."""
