"""Fixed values and Column-level building blocks."""
