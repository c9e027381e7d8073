"""Logging of a driver: the console and, where asked for, a rotating file."""

from __future__ import annotations

import logging
import logging.handlers


def configure(path: str | None = None, level: int = logging.INFO, max_bytes: int = 5 << 20, backups: int = 3) -> None:
    """Send the package's messages to the console and to ``path``, which is rotated at ``max_bytes``."""
    logger = logging.getLogger("weftline")
    logger.setLevel(level)
    for h in list(logger.handlers):
        logger.removeHandler(h)
        h.close()
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if path:
        handlers.append(logging.handlers.RotatingFileHandler(path, maxBytes=max_bytes, backupCount=backups, encoding="utf-8"))
    for h in handlers:
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s", "%Y-%m-%d %H:%M:%S"))
        logger.addHandler(h)
