"""Growth, plans, centres, scores and reports composed from the operators."""
