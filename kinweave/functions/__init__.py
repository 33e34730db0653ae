"""Column-level functions: text, URLs, arrays, Arrow UDFs."""
