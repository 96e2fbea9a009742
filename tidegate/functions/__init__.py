"""Column functions: text, time, space and opening hours."""
