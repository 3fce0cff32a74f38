"""Column expressions and user functions: text, times, vectors, fuzzy names, chunking."""
