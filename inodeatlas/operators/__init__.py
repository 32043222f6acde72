"""Relational operators over inventories, counts, sketches and event logs."""
