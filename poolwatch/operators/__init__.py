"""Relational building blocks that hold up under hot keys."""
