"""Column functions: vectors and bitmaps."""
