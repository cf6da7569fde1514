"""One writer at a time: an advisory lock file with an owner token, a heartbeat, and takeover of stale locks."""

from __future__ import annotations

import os
import threading
import time
import uuid
from pathlib import Path

HEARTBEAT_S, STALE_S, RETRY_S = 2.0, 30.0, 0.05


class Lock:
    """with Lock(path): … ; raises TimeoutError if another owner keeps it longer than `wait` seconds."""

    def __init__(self, path: str | Path, wait: float = 10.0, stale: float = STALE_S):
        self.path, self.wait, self.stale, self.token = Path(path), wait, stale, uuid.uuid4().hex
        self._stop = threading.Event()

    def __enter__(self) -> Lock:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        end = time.monotonic() + self.wait
        while True:
            try:
                fd = os.open(self.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
                os.write(fd, self.token.encode())
                os.close(fd)
                break
            except FileExistsError:
                self._take_over()
                if time.monotonic() > end:
                    raise TimeoutError(f"{self.path} is held") from None
                time.sleep(RETRY_S)
        threading.Thread(target=self._beat, daemon=True).start()
        return self

    def _take_over(self) -> None:
        """Remove a lock whose heartbeat has stopped; by rename, so that only one of several waiters does it."""
        try:
            if time.time() - self.path.stat().st_mtime > self.stale:
                aside = self.path.with_name(f".{self.path.name}.{self.token}")
                os.rename(self.path, aside)
                aside.unlink()
        except OSError:
            pass

    def _beat(self) -> None:
        while not self._stop.wait(HEARTBEAT_S):
            try:
                if self.path.read_text() != self.token:
                    return
                os.utime(self.path)
            except OSError:
                return

    def __exit__(self, *_: object) -> None:
        self._stop.set()
        try:
            if self.path.read_text() == self.token:
                self.path.unlink()
        except OSError:
            pass
