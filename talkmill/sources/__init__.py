"""Reading and writing tables and reports."""
