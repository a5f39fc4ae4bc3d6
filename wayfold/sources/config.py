"""Settings of a deployment, from a TOML manifest or the environment, and the checks on them."""

from __future__ import annotations

import tomllib
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

#: The widest range that a setting is brought into; settings not named here are taken as they are.
BOUNDS = {
    "knn_candidates": (1, 16),
    "projection_radius_meters": (50.0, 5000.0),
    "forest_max_distance_meters": (250.0, 20000.0),
    "snap_tolerance_meters": (25.0, 1000.0),
    "snap_kappa_meters": (5.0, 5000.0),
    "search_window": (64, 16384),
    "changes_poll_secs": (60, None),
}
#: Where settings lie in a manifest when not at its top.
PLACES = {
    "knn_candidates": ("dvni", "knn_candidates"),
    "projection_radius_meters": ("dvni", "max_walk_radius_meters"),
    "forest_max_distance_meters": ("hpf", "max_distance_meters"),
    "snap_tolerance_meters": ("hpf", "snap_tolerance_meters"),
    "snap_kappa_meters": ("hpf", "snap_quadratic_kappa_meters"),
    "search_window": ("hpf", "search_window"),
    "changes_poll_secs": ("osm_diff", "poll_interval_secs"),
}
MOST_FEEDS, MOST_TRANSFERS = 65536, 8


@dataclass(frozen=True)
class Feed:
    id: str
    source: str
    trip_updates_url: str | None = None
    vehicle_positions_url: str | None = None
    depends_on: tuple[str, ...] = ()


@dataclass(frozen=True)
class Settings:
    """Defaults are fixed values."""

    feeds: tuple[Feed, ...] = field(default_factory=tuple)
    walk_radius_meters: float = 450.0
    walk_speed_mps: float = 1.35
    max_transfer_candidates: int = 12
    refresh_interval_secs: int = 45
    static_reload_interval_secs: int = 600
    static_diff_tolerance: float = 0.05
    default_max_transfers: int = 4
    knn_candidates: int = 5
    projection_radius_meters: float = 1500.0
    forest_max_distance_meters: float = 4000.0
    snap_tolerance_meters: float = 140.0
    snap_kappa_meters: float = 40.0
    search_window: int = 512
    changes_poll_secs: int = 1800


def bounded(settings: Settings) -> Settings:
    """Settings brought into their ranges."""
    out = {}
    for name, (least, most) in BOUNDS.items():
        value = max(getattr(settings, name), least)
        out[name] = value if most is None else min(value, most)
    return replace(settings, **out)


def from_manifest(path: str | Path) -> Settings:
    """Read a manifest; a source that is a relative path lies beside it. Unknown keys are ignored."""
    path = Path(path)
    raw = tomllib.loads(path.read_text())
    values = {}
    for f in fields(Settings):
        if f.name == "feeds":
            continue
        table, key = PLACES.get(f.name, (None, f.name))
        found = (raw.get(table) or {} if table else raw).get(key)
        if found is not None:
            values[f.name] = found
    feeds = tuple(_feed(x, path.parent) for x in raw.get("feeds", []))
    check_feeds(feeds)
    return bounded(Settings(feeds=feeds, **values))


def from_environment(env: Mapping[str, str], prefix: str) -> Settings:
    """One feed and the settings named ``prefix`` + upper-case field name; values that are no numbers raise."""
    values = {}
    for f in fields(Settings):
        text = env.get(f"{prefix}{f.name.upper()}")
        if f.name != "feeds" and text is not None:
            values[f.name] = type(f.default)(text.strip())
    get = lambda name: (env.get(prefix + name) or "").strip() or None
    feed = Feed(get("FEED_ID") or "default", get("FEED_SOURCE") or "", get("TRIP_UPDATES_URL"), get("VEHICLE_POSITIONS_URL"))
    check_feeds((feed,))
    return bounded(Settings(feeds=(feed,), **values))


def _feed(raw: dict, folder: Path) -> Feed:
    source = str(raw.get("source", ""))
    if source and "://" not in source and not Path(source).is_absolute():
        source = str(folder / source)
    return Feed(str(raw.get("id", "")).strip(), source, raw.get("trip_updates_url"), raw.get("vehicle_positions_url"), tuple(raw.get("depends_on", ())))


def check_feeds(feeds: Iterable[Feed]) -> None:
    """Raise where there are no feeds or too many, an id is empty, repeated or has a colon, or dependencies are unknown or circular."""
    feeds = list(feeds)
    if not feeds:
        raise ValueError("no feeds are defined")
    if len(feeds) > MOST_FEEDS:
        raise ValueError(f"more than {MOST_FEEDS} feeds")
    by_id: dict[str, Feed] = {}
    for feed in feeds:
        if not feed.id.strip():
            raise ValueError("a feed id is empty")
        if ":" in feed.id:
            raise ValueError(f"feed id {feed.id} has a colon, which separates it from local ids")
        if feed.id in by_id:
            raise ValueError(f"feed id {feed.id} is repeated")
        by_id[feed.id] = feed
    waiting = {k: set(f.depends_on) for k, f in by_id.items()}
    for name, needs in waiting.items():
        if unknown := sorted(needs - by_id.keys()):
            raise ValueError(f"feed {name} depends on unknown feed {unknown[0]}")
    while waiting:  # feeds whose needs are met leave, until none is left or none can
        ready = [k for k, needs in waiting.items() if not needs & waiting.keys()]
        if not ready:
            raise ValueError(f"feeds depend on each other: {', '.join(sorted(waiting))}")
        for k in ready:
            del waiting[k]


def query_transfers(asked: int | None, settings: Settings) -> int:
    """Transfers of a request, between 0 and 8."""
    return min(max(settings.default_max_transfers if asked is None else asked, 0), MOST_TRANSFERS)


def reload_policy(mutated: int, total: int, streets_changed: bool, settings: Settings) -> str:
    """``reuse`` where nothing changed, ``append`` up to the tolerated share of changes, else ``full``."""
    share = mutated / total if total else 0.0
    if share == 0.0 and not streets_changed:
        return "reuse"
    return "append" if share <= settings.static_diff_tolerance else "full"
