"""Whole plans: the monthly inventory, the report, and the registered queries."""
