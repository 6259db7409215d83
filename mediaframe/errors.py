"""What this package raises: a MediaError for anything wrong with files, filters, expressions or options; and its log levels."""

from __future__ import annotations

import logging

#: Names of log levels and their numbers; higher ones say more.
LEVELS = {"quiet": -8, "panic": 0, "fatal": 8, "error": 16, "warning": 24, "info": 32, "verbose": 40, "debug": 48, "trace": 56}

log = logging.getLogger("mediaframe")


class MediaError(ValueError):
    """The input or the request cannot be worked with."""


def set_level(name: str) -> None:
    """Say what a level, or a number, lets through, by the package's logger."""
    number = LEVELS[name] if name in LEVELS else int(name)
    steps = ((16, logging.CRITICAL), (24, logging.ERROR), (32, logging.WARNING), (48, logging.INFO))
    log.setLevel(next((level for below, level in steps if number < below), logging.DEBUG) if number >= 0 else logging.CRITICAL + 1)
