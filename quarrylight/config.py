"""Settings: defaults that carry meaning, overridden by a file of NAME=value lines and by the environment."""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    """Numbers that decide results; names in the environment are in capitals behind ``QUARRYLIGHT_``."""

    top_vectors: int = 10
    top_results: int = 5
    alpha: float = 0.4
    beta: float = 0.4
    gamma: float = 0.2
    evidence_threshold: float = 0.3
    least_results: int = 2
    max_hops: int = 2
    max_nodes: int = 300
    similarity_threshold: float = 0.85
    max_chunk_tokens: int = 512
    overlap_tokens: int = 50
    token_ceiling: int = 7500
    use_graph: bool = True


def read_env_file(path: str) -> dict[str, str]:
    """The NAME=value lines of a file; blank lines and lines that begin with # are passed over, quotes around values taken off."""
    out: dict[str, str] = {}
    if Path(path).exists():
        for line in Path(path).read_text(encoding="utf-8").splitlines():
            name, is_, value = line.strip().partition("=")
            if is_ and not name.startswith("#"):
                out.setdefault(name.strip(), value.strip().strip("\"'"))
    return out


def settings(environ: Mapping[str, str], env_file: str | None = None) -> Settings:
    """Settings from the environment, else from the file, else the defaults; what cannot be read leaves the default, with a warning."""
    given = {**(read_env_file(env_file) if env_file else {}), **environ}
    found = {}
    for f in fields(Settings):
        raw = given.get(f"QUARRYLIGHT_{f.name.upper()}")
        if raw is None:
            continue
        try:
            if isinstance(f.default, bool):
                found[f.name] = {"1": True, "true": True, "yes": True, "on": True, "0": False, "false": False, "no": False, "off": False}[raw.strip().lower()]
            else:
                found[f.name] = type(f.default)(raw)
        except (ValueError, KeyError):
            warnings.warn(f"{f.name}: {raw!r} cannot be read, {f.default!r} is used", stacklevel=2)
    return Settings(**found)
