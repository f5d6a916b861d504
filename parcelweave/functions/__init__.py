"""Column helpers: pure expressions, no actions."""
