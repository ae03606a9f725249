"""Evaluation: seeded tasks, a mechanical receiver, the strategy matrix, and the fault experiment."""
