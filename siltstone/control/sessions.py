"""Sessions in the driver: the last messages of each, and what was said before about a question."""

from __future__ import annotations

import re
from collections import defaultdict, deque
from difflib import SequenceMatcher
from threading import Lock
from typing import NamedTuple


class Message(NamedTuple):
    role: str  # user or assistant
    content: str


class Sessions:
    """The last `turns` pairs of messages of each session; safe for several threads."""

    def __init__(self, turns: int = 10) -> None:
        self.turns = turns
        self._held: dict[str, deque[Message]] = defaultdict(lambda: deque(maxlen=2 * turns))
        self._lock = Lock()

    def get(self, session: str) -> list[Message]:
        with self._lock:
            return list(self._held[session]) if session in self._held else []

    def add(self, session: str, messages: list[Message]) -> None:
        with self._lock:
            self._held[session].extend(messages)

    def clear(self, session: str | None = None) -> None:
        """Forgets one session, or all."""
        with self._lock:
            self._held.clear() if session is None else self._held.pop(session, None)

    def names(self) -> list[str]:
        with self._lock:
            return list(self._held)

    def length(self, session: str) -> int:
        return len(self.get(session))

    def last_turns(self, session: str, n: int) -> list[Message]:
        """The last n turns; all for n = 0."""
        held = self.get(session)
        return held[-2 * n :] if n else held

    def recall(self, session: str, query: str, k: int = 1, least: float = 0.35, turns: int = 6, most: tuple[int, int] = (80, 220)) -> list[dict]:
        """The k turns most like the query, with shortened question and answer and their score."""
        held = self.last_turns(session, turns)
        pairs = [(a.content, b.content) for a, b in zip(held, held[1:], strict=False) if (a.role, b.role) == ("user", "assistant")]
        q = _folded(query)
        scored = [(max(_alike(q, _folded(x)), 0.8 * _alike(q, _folded(y[:300]))), x, y) for x, y in pairs]
        best = sorted((s for s in scored if s[0] >= least), key=lambda s: -s[0])[:k]
        return [{"question": _short(x, most[0]), "answer": _short(y, most[1]), "score": round(s, 4)} for s, x, y in best]


def _folded(text: str) -> str:
    return re.sub(r"\s+", " ", text.lower().strip())


def _alike(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def _short(text: str, most: int) -> str:
    return text if len(text) <= most else text[:most] + "..."
