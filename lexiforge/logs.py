"""Logging to a file that rotates at 10 MB, five kept; each record is flushed."""

import logging
import logging.handlers
from pathlib import Path


def configure(path: str, level: str = "INFO") -> logging.Logger:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    handler = logging.handlers.RotatingFileHandler(path, maxBytes=10 << 20, backupCount=5, encoding="utf-8")
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
    root = logging.getLogger("lexiforge")
    for old in list(root.handlers):
        root.removeHandler(old)
        old.close()
    root.addHandler(handler)
    root.setLevel(level.upper())
    return root
