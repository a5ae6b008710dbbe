"""How SQL text meets a dataset."""
