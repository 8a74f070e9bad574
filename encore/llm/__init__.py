"""Operators for training-data pipelines: ten operators, their queries and the helpers only they use."""
