"""Queries over the driver's tables, one module for each section of the inventory."""
