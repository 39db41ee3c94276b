"""The stage runner: stages in order, fatal and warning failures, conditional halts, one run at a time."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

FATAL, WARNING = "fatal", "warning"


@dataclass
class Stage:
    name: str
    run: Callable[[dict], dict]
    severity: str = FATAL
    #: Gets the state after the stage; False halts the run.
    proceed: Callable[[dict], bool] = lambda state: True


@dataclass
class RunState:
    status: str = "idle"
    stage: str = ""
    started_at: str = ""
    finished_at: str = ""
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


class AlreadyRunning(RuntimeError):
    pass


class Pipeline:
    """Each stage is a function of the state (tables by name and counts) that returns what it adds."""

    def __init__(self, stages: list[Stage]) -> None:
        self.stages = stages
        self.state = RunState()
        self._lock = threading.Lock()

    def run(self, state: dict | None = None, skip: frozenset[str] = frozenset()) -> dict:
        todo = [s for s in self.stages if s.name not in skip]
        if not todo:
            raise ValueError("nothing to run")
        with self._lock:
            if self.state.status == "running":
                raise AlreadyRunning(self.state.stage)
            self.state = RunState("running", started_at=datetime.now(UTC).isoformat())
        data = dict(state or {})
        status = "completed"
        for s in todo:
            self.state.stage = s.name
            try:
                data |= s.run(data)
            except Exception as e:  # noqa: BLE001
                if s.severity == FATAL:
                    self.state.errors.append(f"{s.name}: {e}")
                    status = "failed"
                    break
                self.state.warnings.append(f"{s.name}: {e}")
                continue
            if not s.proceed(data):
                status = "halted"
                break
        self.state.status, self.state.finished_at = status, datetime.now(UTC).isoformat()
        return data
