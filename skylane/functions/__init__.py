"""Column functions: pure expressions over any batch or streaming frame."""
