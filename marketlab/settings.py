"""Settings from the environment, read once and passed on; secrets do not print."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field


class Secret(str):
    """Text that shows as stars."""

    def __repr__(self) -> str:
        return "'***'" if self else "''"

    __str__ = __repr__

    @property
    def value(self) -> str:
        return str.__str__(self)


@dataclass(frozen=True)
class Settings:
    """MARKETLAB_STORE, _ZONE, _HOT_DAYS, _MAX_BARS, _API_HOST, _API_PORT, _API_KEY, _VENDOR_KEY and _VENDOR_PREMIUM."""

    store: str = "bars"
    zone: str = "UTC"
    hot_days: int = 30
    max_bars: int = 10_000
    api_host: str = "127.0.0.1"
    api_port: int = 8088
    api_key: Secret = field(default_factory=Secret)
    vendor_key: Secret = field(default_factory=Secret)
    vendor_premium: bool = False

    @staticmethod
    def read(env: Mapping[str, str] | None = None) -> Settings:
        """Unset and empty variables leave the defaults."""
        env = os.environ if env is None else env
        got = {}
        for name, default in Settings().__dict__.items():
            if text := env.get(f"MARKETLAB_{name.upper()}", "").strip():
                got[name] = text.lower() in ("1", "true", "yes") if isinstance(default, bool) else type(default)(text)
        return Settings(**got)
