"""Tables between steps: see ``pitwise.sources.scratch``."""

from pitwise.sources.scratch import cut, forget, new_path, remove, shared_dir

__all__ = ["cut", "forget", "new_path", "remove", "shared_dir"]
