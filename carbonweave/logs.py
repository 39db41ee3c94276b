"""The log sink: console and, where named, a file; set up once."""

from __future__ import annotations

import logging
import sys
from pathlib import Path

#: Fixed value: the line of a log.
LINE = "%(asctime)s | %(levelname)-8s | %(name)s |  %(message)s"


def setup_logging(log_file: str | Path | None = None, level: int = logging.INFO) -> None:
    """Adds the sinks to the root logger unless it has some already."""
    root = logging.getLogger()
    if root.handlers:
        return
    root.setLevel(level)
    sinks: list[logging.Handler] = [logging.StreamHandler(sys.stdout)]
    if log_file is not None:
        Path(log_file).parent.mkdir(parents=True, exist_ok=True)
        sinks.append(logging.FileHandler(log_file, encoding="utf-8"))
    for s in sinks:
        s.setFormatter(logging.Formatter(LINE))
        root.addHandler(s)
