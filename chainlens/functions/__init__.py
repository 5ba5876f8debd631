"""Column-level helpers and fixed business values."""
