"""Column expressions shared by the operators. Built-in functions only, no UDFs."""
