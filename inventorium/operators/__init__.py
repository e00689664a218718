"""Operators over inventories, assignments, classified inventories and run logs."""
