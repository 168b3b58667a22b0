"""Registered queries of the engine itself, by family."""
