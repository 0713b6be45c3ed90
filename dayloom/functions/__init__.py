"""Column expressions shared by queries and operators."""
