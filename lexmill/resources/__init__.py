"""Word lists that the engine ships."""

from __future__ import annotations

import importlib.resources


def words(name: str) -> tuple[str, ...]:
    """Words of the list ``name``; lines that begin with # are comments. Read from a folder or a zip of the package."""
    lines = importlib.resources.files(__name__).joinpath(f"{name}.txt").read_text(encoding="utf-8").splitlines()
    return tuple(dict.fromkeys(w for x in lines if not x.startswith("#") for w in x.split()))
