"""Column expressions and stencil helpers."""
