"""The library's shared tables, under the name that this subpackage uses."""

from __future__ import annotations

from corvane.runtime import discard, fresh_path, publish, qualified, shared_dir, ship

__all__ = ["discard", "fresh_path", "publish", "qualified", "shared_dir", "ship"]
