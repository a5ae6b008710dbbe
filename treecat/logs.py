"""Logging on request."""

from __future__ import annotations

import logging

logger = logging.getLogger("treecat")
logger.addHandler(logging.NullHandler())


def verbose(level: bool | str = True) -> None:
    """True or "info", "debug", or False for silence."""
    levels = {True: logging.INFO, "info": logging.INFO, "debug": logging.DEBUG, False: logging.CRITICAL + 1}
    if level not in levels:
        raise ValueError(f"level is True, False, 'info' or 'debug', not {level!r}")
    logger.handlers = [logging.NullHandler() if level is False else logging.StreamHandler()]
    logger.setLevel(levels[level])
