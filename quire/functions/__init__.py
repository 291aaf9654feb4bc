"""Column expressions on text, signals and names."""
