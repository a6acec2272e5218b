"""Settings of a run: parameters from a file, the analysis instant, windows, the digest that guards reuse."""

from __future__ import annotations

import hashlib
import json
import tomllib
from collections.abc import Mapping
from dataclasses import asdict, fields, replace
from datetime import UTC, datetime, timedelta

from kenmap.params import Params

#: Parameters that name what is asked for; they change no score.
ASKED = frozenset({"target", "removed", "as_of", "repo_id", "rule_file"})


def load(text: str, base: Params = Params()) -> Params:
    """Parameters from TOML; an unknown name or a value of another kind is an error."""
    kinds = {f.name: type(getattr(base, f.name)) for f in fields(base)}
    given = tomllib.loads(text)
    for name, value in given.items():
        if name not in kinds:
            raise ValueError(f"unknown parameter {name!r}")
        if isinstance(value, bool) or not isinstance(value, (int, float) if kinds[name] is float else kinds[name]):
            raise ValueError(f"parameter {name!r} must be {kinds[name].__name__}")
    checked = replace(base, **{n: kinds[n](v) for n, v in given.items()})
    for name in ("threshold", "blame_override", "major_share", "monopoly", "completeness"):
        if not 0 <= getattr(checked, name) <= 1:
            raise ValueError(f"parameter {name!r} must lie between 0 and 1")
    return checked


def digest(params: Params, more: Mapping[str, object] | None = None) -> str:
    """SHA-256 of all that a score depends on."""
    kept = {k: v for k, v in asdict(params).items() if k not in ASKED}
    return hashlib.sha256(json.dumps({"params": kept, "more": dict(more or {})}, sort_keys=True).encode()).hexdigest()


def instant(text: str) -> datetime:
    """An ISO instant in UTC; one without a zone is UTC."""
    try:
        parsed = datetime.fromisoformat(text)
    except ValueError as error:
        raise ValueError(f"not an instant: {text!r}") from error
    return parsed.replace(tzinfo=UTC) if parsed.tzinfo is None else parsed.astimezone(UTC)


def resolve_instant(given: str | None, epoch: str | None, newest_commit: datetime | None) -> datetime:
    """The instant of an analysis: as given, else the source epoch, else the newest commit; never the clock."""
    if given:
        return instant(given)
    if epoch:
        return datetime.fromtimestamp(int(epoch), UTC)
    if newest_commit is None:
        raise ValueError("an analysis needs an instant or a commit")
    return newest_commit


def window_start(as_of: datetime, days: int) -> datetime | None:
    """Begin of the window of ``days`` days; none where it is unbounded."""
    return as_of - timedelta(days=days) if days > 0 else None


def whole_days(later: datetime, earlier: datetime) -> int:
    return max(0, (later - earlier).days)


def remote(url: str) -> str:
    """host/owner/name of a remote address, whatever its form."""
    bare = url.strip().removesuffix("/").removesuffix(".git")
    bare = bare.split("://", 1)[1] if "://" in bare else bare.replace(":", "/", 1)
    host, _, path = bare.rpartition("@")[2].partition("/")
    return f"{host.split(':')[0].lower()}/{path}"
