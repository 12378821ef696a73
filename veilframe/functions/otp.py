"""One-time codes that authorise restoring: counter and time based, SHA-256, 8 digits, 30 seconds. On the driver."""

from __future__ import annotations

import hashlib
import hmac
from dataclasses import dataclass, field

DIGITS, STEP = 8, 30


def hotp(secret: bytes, counter: int) -> str:
    mac = hmac.new(secret, counter.to_bytes(8, "big"), hashlib.sha256).digest()
    at = mac[-1] & 15
    return str((int.from_bytes(mac[at : at + 4], "big") & 0x7FFFFFFF) % 10**DIGITS).zfill(DIGITS)


@dataclass
class Verifier:
    """Accepts a code of this step or one next to it, each step once a caller."""

    secret: bytes
    last: dict[str, int] = field(default_factory=dict)

    def verify(self, caller: str, code: str, now: float) -> bool:
        for step in (int(now) // STEP + d for d in (0, -1, 1)):
            if step > self.last.get(caller, -1) and hmac.compare_digest(hotp(self.secret, step), code):
                self.last[caller] = step
                return True
        return False
