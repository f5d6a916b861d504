"""Generic relational operators shared by the plans."""
