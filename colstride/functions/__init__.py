"""Column expressions: unsigned 64-bit arithmetic, bit widths, lane primitives."""
