"""Log files of the command line."""

from __future__ import annotations

import logging
from pathlib import Path

NAME = "barloom"


def log_to(file: str | None = None, level: str = "INFO") -> logging.Logger:
    """The engine's logger, which writes to ``file`` as well from now on (its folder is made); an unknown level counts as INFO."""
    log = logging.getLogger(NAME)
    log.setLevel(getattr(logging, level.upper(), logging.INFO))
    path = Path(file).resolve() if file else None
    if path and not any(getattr(h, "baseFilename", None) == str(path) for h in log.handlers):
        path.parent.mkdir(parents=True, exist_ok=True)
        to_file = logging.FileHandler(path, encoding="utf-8")
        to_file.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(to_file)
    return log
