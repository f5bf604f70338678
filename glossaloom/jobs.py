"""A log of jobs in a project's folder: one small file for each event, so that writers never meet in one file."""

from __future__ import annotations

import json
import os
import socket
import time
import uuid
from pathlib import Path

KINDS = ("ext", "nb_train", "rf_train", "pipe")


class JobRegistry:
    """Jobs of one kind. Events are only ever added; the state of a job is what its events say, in the order of their times."""

    def __init__(self, folder: str, kind: str):
        if kind not in KINDS:
            raise ValueError(f"no such kind: {kind!r}")
        self.path = Path(folder) / f"{kind}_jobs"

    def _write(self, job: str, event: dict) -> None:
        """An event is whole or not there: it is written under another name and linked to its own."""
        self.path.mkdir(parents=True, exist_ok=True)
        name = f"{time.time_ns():020}-{uuid.uuid4().hex}"
        held = self.path / f".{name}"
        held.write_text(json.dumps({"pid": job, **event}))
        held.rename(self.path / f"{name}.json")

    def _claim(self) -> str:
        """The next free number; a file that only one writer can create keeps it."""
        self.path.mkdir(parents=True, exist_ok=True)
        number = 1 + max((int(p.name.removeprefix("claim-")) for p in self.path.glob("claim-*")), default=0)
        while True:
            try:
                os.close(os.open(self.path / f"claim-{number}", os.O_CREAT | os.O_EXCL))
                return str(number)
            except FileExistsError:
                number += 1

    def _save(self, jobs: list[dict]) -> None:
        """Tell the whole state of jobs once more."""
        for j in jobs:
            self._write(j["pid"], j)

    def events(self) -> list[dict]:
        """All events, oldest first."""
        return [json.loads(p.read_text()) for p in sorted(self.path.glob("*.json"))] if self.path.exists() else []

    def all(self) -> list[dict]:
        jobs: dict[str, dict] = {}
        for event in self.events():
            job = event["pid"]
            if event.get("status") == "Removed":
                jobs.pop(job, None)
            elif job in jobs:
                jobs[job] |= event
            elif "name" in event:  # events of a removed job say nothing
                jobs[job] = event
        return sorted(jobs.values(), key=lambda j: int(j["pid"]))

    def add(self, name: str, **more) -> str:
        """Log a job that starts; gives its id."""
        job = self._claim()
        self._write(job, {"name": name, "start": time.time(), "elapsed": "", "status": "Running", "owner": os.getpid(), "host": socket.gethostname(), **more})
        return job

    def finish(self, job: str, status: str = "Finished", **more) -> None:
        start = next((j["start"] for j in self.all() if j["pid"] == job), None)
        if start is not None:
            self._write(job, {"status": status, "elapsed": duration(time.time() - start), **more})

    def remove(self, job: str) -> None:
        self._write(job, {"status": "Removed"})

    def reconcile(self) -> None:
        """Jobs whose process on this host is gone have failed."""
        for j in self.all():
            if j["status"] == "Running" and j["host"] == socket.gethostname() and not Path(f"/proc/{j['owner']}").exists():
                self._write(j["pid"], {"status": "Failed"})

    def finished(self, column: str | None = None) -> list[dict]:
        """Finished jobs; with ``column``, those whose ``columns`` name it, such as extracts that have a text."""
        return [j for j in self.all() if j["status"] == "Finished" and (column is None or column in j.get("columns", ()))]

    def exists(self, name: str) -> bool:
        return any(j["name"] == name for j in self.all())

    def best(self, tag: str, *, score: str = "f1") -> list[dict]:
        """Finished trainings that have a classifier of the tag, the one of the best score first; ``scores`` is {tag: {score: value}}."""
        told = [j for j in self.finished() if tag in j.get("scores", {})]
        return sorted(told, key=lambda j: (-j["scores"][tag][score], int(j["pid"])))


def duration(seconds: float) -> str:
    hours, rest = divmod(int(seconds), 3600)
    return f"{hours:02}:{rest // 60:02}:{rest % 60:02}"
