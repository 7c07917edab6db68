"""Columns as frames ``(pos, v)``: literals, Parquet, raw binary, generators, printing, caching."""
