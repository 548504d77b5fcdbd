"""Large-scale training-data operators (language id, dedup, mixing, packing, ...)."""
