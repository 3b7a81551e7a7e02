"""Column helpers shared by the operators; everything stays a built-in expression."""
