"""Whole pipelines put together from operators, the registry of components and the command line."""
