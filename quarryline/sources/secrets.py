"""The salt of splits: from the environment or a file outside the repository, never shown."""

from __future__ import annotations

import os
from collections.abc import Mapping
from pathlib import Path


class MissingSalt(RuntimeError):
    """No salt is set, its file is empty, or lies inside the repository."""


def load_salt(variable: str, file_variable: str, default: str, repository: str, environ: Mapping[str, str] | None = None) -> str:
    """The trimmed salt of ``variable``, else of the file that ``file_variable`` names, else of ``default``.

    A file inside ``repository`` is refused, since a salt must not be
    committed; links are followed first.
    """
    env = os.environ if environ is None else environ
    if own := (env.get(variable) or "").strip():
        return own
    path = Path((env.get(file_variable) or "").strip() or default).expanduser()
    if path.resolve().is_relative_to(Path(repository).resolve()):
        raise MissingSalt(f"{path} lies inside the repository; set {variable} or a file outside")
    if not path.is_file():
        raise MissingSalt(f"set {variable} or write the salt to {path}")
    if not (salt := path.read_text(encoding="utf-8").strip()):
        raise MissingSalt(f"{path} is empty")
    return salt
