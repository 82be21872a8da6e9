"""Column functions: Column in, Column out."""
