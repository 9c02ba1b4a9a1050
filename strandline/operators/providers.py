"""Boundary to model-backed steps: an interface, a registry and an offline stub that has no opinion."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Request:
    kind: str
    payload: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Response:
    """opinion is None where the provider has none: callers then fall through to UNKNOWN."""

    opinion: str | None = None
    cited: tuple[str, ...] = ()
    degraded: bool = False


class Provider(ABC):
    @abstractmethod
    def send(self, request: Request) -> Response: ...


_PROVIDERS: dict[str, Callable[[], Provider]] = {}


def register(name: str) -> Callable[[type[Provider]], type[Provider]]:
    def add(cls: type[Provider]) -> type[Provider]:
        _PROVIDERS[name] = cls
        return cls

    return add


def create(name: str = "offline") -> Provider:
    if name not in _PROVIDERS:
        raise KeyError(f"no provider {name!r}; known: {sorted(_PROVIDERS)}")
    return _PROVIDERS[name]()


@register("offline")
class Offline(Provider):
    def send(self, request: Request) -> Response:
        return Response()


def explore(attempts: DataFrame, provider: Provider, key: str = "report_key", most: int = 10) -> list[dict]:
    """Ask the provider about a report's attempts in order, at most ten of them, and stop at the first TP.

    attempts is one report's; the loop is sequential by nature, as each answer decides whether another is asked."""
    found = []
    for row in attempts.orderBy("attempt").limit(min(most, 10)).collect():
        answer = provider.send(Request("attempt", row.asDict(recursive=True)))
        found.append({key: row[key], "attempt": row["attempt"], "verdict": answer.opinion or "UNKNOWN", "degraded": answer.degraded})
        if answer.opinion == "TP":
            break
    return found


def unanswered(df: DataFrame) -> DataFrame:
    """Rows to which an offline provider was put: verdict UNKNOWN, never a guess."""
    return df.withColumn("verdict", F.lit("UNKNOWN"))
