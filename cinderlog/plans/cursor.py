"""Opaque page cursors: base64 of a JSON object with the last row's timestamp and id."""

from __future__ import annotations

import base64
import binascii
import json
from dataclasses import dataclass
from datetime import datetime

from cinderlog.functions.times import parse_iso


@dataclass(frozen=True)
class Cursor:
    timestamp: datetime
    id: int

    def encode(self) -> str:
        stamp = self.timestamp.isoformat(timespec="microseconds") + "Z"
        text = json.dumps({"timestamp": stamp, "id": self.id}, separators=(",", ":"))
        return base64.b64encode(text.encode()).decode()

    @staticmethod
    def decode(text: str) -> "Cursor":
        try:
            value = json.loads(base64.b64decode(text))
        except (binascii.Error, ValueError):
            raise ValueError("invalid cursor") from None
        if not isinstance(value, dict):
            raise ValueError("invalid cursor")
        stamp, row_id = value.get("timestamp"), value.get("id")
        parsed = parse_iso(stamp) if isinstance(stamp, str) else None
        if parsed is None or type(row_id) is not int:
            raise ValueError("invalid cursor")
        return Cursor(parsed, row_id)
