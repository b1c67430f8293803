"""Stress marks and speech text for Ukrainian, over DataFrames."""

from importlib import import_module

# Imported on first use, so that workers which need one module do not load all.
_HOMES = {
    "AssetError": "errors", "DzvinError": "errors", "NormalizationError": "errors", "ServingError": "errors",
    "Lexicon": "sources.archive", "SpeechFrontend": "plans.engine", "StressEngine": "plans.engine",
}
__all__ = sorted(_HOMES)


def __getattr__(name: str):
    if name in _HOMES:
        return getattr(import_module(f"dzvin.{_HOMES[name]}"), name)
    raise AttributeError(name)
