"""A PySpark-native engine for digitised page collections."""

import importlib

_EXPORTS = {"Pipeline": "plans.pipeline"} | {name: "schema" for name in ("BBOX", "DICTIONARY", "LINES", "PAGES", "REGIONS")}
__all__ = sorted(_EXPORTS)


def __getattr__(name: str):
    """Exports are imported when first used, so that Python workers that need one module load no other."""
    if name in _EXPORTS:
        return getattr(importlib.import_module(f"{__name__}.{_EXPORTS[name]}"), name)
    raise AttributeError(name)
