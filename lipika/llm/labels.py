"""Labels and image ids in one writing: the library's own expressions."""

from lipika.functions.labels import DEFAULT_ENGINE, engine, image_key, label

__all__ = ["DEFAULT_ENGINE", "engine", "image_key", "label"]
