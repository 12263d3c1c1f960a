"""Column functions: no state, no shuffle."""
