"""Column expressions: no Python worker unless a module says so."""
