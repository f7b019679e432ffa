"""Imports every model-based filter, so that the registry holds them."""

from weftline.operators import alignment, embeddings, language_id, language_models

__all__ = ["alignment", "embeddings", "language_id", "language_models"]
