"""Column functions: text, numbers, units and the features of product lines."""
