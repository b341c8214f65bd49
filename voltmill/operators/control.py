"""Driver-side pure functions of scheduling: retries, back-off, rate limits, job runs, model registry."""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field

# HTTP states worth another try, states that a message may name, and words of refusals and lost connections.
RETRYABLE = (429, 500, 502, 503, 504)
NAMED_TRANSIENT, NAMED_PERMANENT = (500, 502, 503, 504), (400, 401, 403, 404)
REFUSED = ("unauthorized", "authentication failed", "forbidden", "invalid api key", "missing api key")
DISCONNECTED = ("could not connect", "connection closed")


def classify_failure(error: BaseException | None) -> str:
    """TRANSIENT, PERMANENT or UNKNOWN: by type, then the HTTP state the error carries, then the one its message names."""
    if error is None:
        return "UNKNOWN"
    name, text = type(error).__name__.lower(), str(error).lower()
    if "candidatelookuperror" in name:
        return "TRANSIENT"
    if "credential" in name or isinstance(error, (PermissionError, ValueError, KeyError, TypeError)) or any(w in text for w in REFUSED):
        return "PERMANENT"
    status = getattr(getattr(error, "response", None), "status_code", None) or getattr(error, "status_code", None)
    if status is not None and status >= 400:
        return "TRANSIENT" if status in RETRYABLE or status >= 500 else "PERMANENT"
    named = {int(c) for c in re.findall(r"(?:http|status) (\d{3})", text)}
    if "429" in text or "rate limit" in text or named & set(NAMED_TRANSIENT):
        return "TRANSIENT"
    if named & set(NAMED_PERMANENT):
        return "PERMANENT"
    lost = isinstance(error, (TimeoutError, ConnectionError)) or any(w in name for w in ("timeout", "connectionerror", "connectionreset", "operationalerror"))
    if lost or any(w in text for w in DISCONNECTED):
        return "TRANSIENT"
    return "PERMANENT" if "integrityerror" in name or "programmingerror" in name else "UNKNOWN"


def backoff_seconds(attempt: int, first: float = 1.0, factor: float = 2.0, most: float = 60.0, retry_after: float | None = None, uniform: Callable[[], float] | None = None) -> float:
    """Exponential delay of the attempt (from 1), at least what the server asks for, else within 20 per cent of it; never over most."""
    base = min(most, first * factor ** max(0, attempt - 1))
    delay = max(base, retry_after) if retry_after and retry_after > 0 else base * (0.8 + 0.4 * uniform()) if uniform else base
    return round(min(most, max(0.0, delay)), 3)


@dataclass
class FixedWindow:
    """A rate limit per key that starts anew when its window has passed."""

    limit: int
    window_s: float
    seen: dict[str, tuple[int, float]] = field(default_factory=dict)

    def allow(self, key: str, now: float) -> tuple[bool, float]:
        """Whether a call may go on, and the seconds to wait if not."""
        count, until = self.seen.get(key, (0, 0.0))
        if until <= now:
            count, until = 0, now + self.window_s
        if count >= self.limit:
            return False, until - now
        self.seen[key] = (count + 1, until)
        return True, 0.0


def run_jobs(jobs: list[tuple[str, Callable[[], dict[str, int]]]]) -> list[dict]:
    """Run jobs in order; skips or warnings make one PARTIAL, an error FAILED and ends the run."""
    out = []
    for name, job in jobs:
        began = time.time()
        try:
            counts = job()
            state = "PARTIAL" if counts.get("skipped") or counts.get("warnings") else "SUCCEEDED"
            error = None
        except Exception as e:  # accounted for, then no later job runs on half a load
            counts, state, error = {}, "FAILED", str(e)
        out.append({"job": name, "state": state, "counts": counts, "error": error, "seconds": time.time() - began})
        if state == "FAILED":
            break
    return out


class RegistryError(RuntimeError):
    """The registry refuses."""


class ModelRegistry:
    """Model files with checked hashes, explicit approval, and roll-back along the log of approvals."""

    def __init__(self, folder: str, features: list[str], allow_synthetic: bool = False):
        self.folder, self.features, self.allow_synthetic = folder, features, allow_synthetic
        os.makedirs(folder, exist_ok=True)

    def _path(self, version: str, kind: str) -> str:
        if not version or os.path.basename(version) != version or version.startswith("."):
            raise RegistryError(f"bad version {version!r}")
        return os.path.join(self.folder, f"{version}.{kind}")

    def _write(self, path: str, value: object) -> None:
        with open(f"{path}.new", "w", encoding="utf-8") as f:
            json.dump(value, f)
        os.replace(f"{path}.new", path)

    def _log(self) -> list[dict]:
        path = os.path.join(self.folder, "log.json")
        if not os.path.exists(path):
            return []
        with open(path, encoding="utf-8") as f:
            return json.load(f)

    def _append(self, event: dict) -> None:
        self._write(os.path.join(self.folder, "log.json"), [*self._log(), event])

    def save(self, version: str, data: bytes, **facts: object) -> None:
        with open(self._path(version, "model"), "wb") as f:
            f.write(data)
        self._write(self._path(version, "json"), {**facts, "version": version, "sha256": hashlib.sha256(data).hexdigest(), "features": self.features, "approved": False})

    def verify(self, version: str) -> tuple[dict | None, list[str]]:
        """The model's facts and what is wrong with it."""
        try:
            with open(self._path(version, "json"), encoding="utf-8") as f:
                facts = json.load(f)
        except (OSError, ValueError) as e:
            return None, [f"facts: {e}"]
        wrong = [] if facts.get("features") == self.features else ["features differ"]
        try:
            with open(self._path(version, "model"), "rb") as f:
                if hashlib.sha256(f.read()).hexdigest() != facts.get("sha256"):
                    wrong.append("bytes differ from their hash")
        except OSError as e:
            wrong.append(str(e))
        return facts, wrong

    def approve(self, version: str, approver: str, reason: str = "") -> dict:
        """Make a model the active one; one that doesn't beat its baseline needs a reason, a synthetic one is refused."""
        facts, wrong = self.verify(version)
        if wrong or not approver.strip():
            raise RegistryError("; ".join(wrong) or "no approver")
        if facts.get("synthetic") and not self.allow_synthetic:
            raise RegistryError("a synthetic model never serves")
        if facts.get("beats_baseline") is not True and not reason.strip():
            raise RegistryError("it doesn't beat its baseline and no reason is given")
        facts |= {"approved": True, "approver": approver, "reason": reason}
        self._write(self._path(version, "json"), facts)
        self._append({"event": "approve", "version": version, "approver": approver})
        self._write(os.path.join(self.folder, "active.json"), version)
        return facts

    def active(self) -> dict | None:
        path = os.path.join(self.folder, "active.json")
        if not os.path.exists(path):
            return None
        with open(path, encoding="utf-8") as f:
            facts, wrong = self.verify(json.load(f))
        return facts if facts and not wrong and facts.get("approved") else None

    def roll_back(self, approver: str) -> dict:
        """Go back to the newest other approved version that is still sound."""
        now = (self.active() or {}).get("version")
        for e in reversed(self._log()):
            if e["event"] == "approve" and e["version"] != now:
                facts, wrong = self.verify(e["version"])
                if facts and not wrong and facts.get("approved"):
                    self._append({"event": "rollback", "version": e["version"], "from": now, "approver": approver})
                    self._write(os.path.join(self.folder, "active.json"), e["version"])
                    return facts
        raise RegistryError("nothing to go back to")
