"""Column expressions and the order-aware building blocks shared by operators."""
