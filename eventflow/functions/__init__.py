"""Column functions: no data access, no actions."""
