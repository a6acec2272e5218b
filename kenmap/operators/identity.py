"""The trail of identity merges: an append-only list of events, from which the current records follow.

People are few beside their events, so this is a fold on the driver over a small list; ``insight`` finds what to merge.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field


def bare(name: str) -> str:
    return name.strip().lower().lstrip("@")


@dataclass(frozen=True)
class Event:
    action: str  # merge or unmerge
    left: str
    right: str
    into: str


@dataclass(frozen=True)
class Record:
    handle: str
    emails: tuple[str, ...] = ()
    names: tuple[str, ...] = ()


@dataclass
class Identities:
    """Records by handle, pairs that stay apart, and the trail."""

    records: dict[str, Record] = field(default_factory=dict)
    apart: set[frozenset[str]] = field(default_factory=set)
    trail: list[Event] = field(default_factory=list)
    before: list[tuple[Record, Record]] = field(default_factory=list)

    def separated(self, a: str, b: str) -> bool:
        return frozenset((bare(a), bare(b))) in self.apart

    def merge(self, left: str, right: str, into: str) -> bool:
        """Join two records under ``into``, also a pair that was kept apart before; False where they are already one."""
        one, two, there = (self.records.get(h, Record(h)) for h in (left, right, into))
        mine = {*one.emails, *two.emails, *one.names, *two.names}
        if into in self.records and into not in (left, right) and mine <= {*there.emails, *there.names}:
            return False
        join = lambda *parts: tuple(dict.fromkeys(x for p in parts for x in p))
        for h in (left, right):
            self.records.pop(h, None)
        own = self.records.pop(into, Record(into))
        self.records[into] = Record(into, join(own.emails, one.emails, two.emails), join(own.names, one.names, two.names))
        self.trail.append(Event("merge", left, right, into))
        self.before.append((one, two))
        return True

    def revert(self, left: str, right: str) -> bool:
        """Undo the latest merge of the pair and keep it apart from now on."""
        pair = {bare(left), bare(right)}
        for i in range(len(self.trail) - 1, -1, -1):
            event = self.trail[i]
            if event.action == "merge" and {bare(event.left), bare(event.right)} == pair:
                self.records.pop(event.into, None)
                self.records |= {r.handle: r for r in self.before[i]}
                self.apart.add(frozenset(pair))
                self.trail.append(Event("unmerge", left, right, event.into))
                self.before.append(self.before[i])
                return True
        return False


def certain_groups(tags: Iterable[tuple[str, str, bool]], apart: Iterable[tuple[str, str]]) -> list[list[str]]:
    """Groups of (original, resolved, certain) identities in their order: one resolves to the group's handle and is kept apart from none of it."""
    pairs = {frozenset((bare(a), bare(b))) for a, b in apart}
    groups: list[tuple[str | None, list[str]]] = []
    for original, resolved, certain in tags:
        home = next((own for key, own in groups if certain and key == bare(resolved) and not any(frozenset((bare(original), bare(x))) in pairs for x in own)), None)
        if home is None:
            groups.append((bare(resolved) if certain else None, [original]))
        else:
            home.append(original)
    return [own for _, own in groups]


def shown_names(tags: Iterable[tuple[str, str, bool]], apart: Iterable[tuple[str, str]]) -> dict[str, str]:
    """The name to show for each original: what it resolves to, but its own where another certain one of the same handle is kept apart from it."""
    pairs, rows = {frozenset((bare(a), bare(b))) for a, b in apart}, list(tags)
    shown = {}
    for group in certain_groups(rows, apart):
        for name in group:
            resolved, certain = next((r, c) for o, r, c in rows if o == name)
            rivals = [o for o, r, c in rows if c and o != name and bare(r) == bare(resolved) and frozenset((bare(o), bare(name))) in pairs]
            shown[name] = name if certain and rivals and name == group[0] else resolved
    return shown


def redacted(payload: object, hidden: Iterable[str], label: str = "[removed]") -> object:
    """``payload`` (what JSON can hold) without the hidden identities: keys and list entries that are one go, texts lose every mention."""
    keys = {k for name in hidden if name.strip() for k in (bare(name), f"@{bare(name)}")}

    def walk(value: object) -> object:
        if isinstance(value, Mapping):
            return {k: walk(v) for k, v in value.items() if str(k).lower() not in keys}
        if isinstance(value, list):
            return [walk(v) for v in value if not (isinstance(v, str) and v.lower() in keys)]
        if isinstance(value, str):
            if value.lower() in keys:
                return label
            for key in sorted(keys, key=len, reverse=True):
                at = value.lower().find(key)
                while at >= 0:
                    value = value[:at] + label + value[at + len(key) :]
                    at = value.lower().find(key, at + len(label))
        return value

    return walk(payload)
