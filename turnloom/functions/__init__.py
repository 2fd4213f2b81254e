"""Column functions: text, guard, credential shapes and statistics."""
