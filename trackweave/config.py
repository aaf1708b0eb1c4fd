"""Settings as a nested table, looked up by path."""

from __future__ import annotations

from trackweave import __version__

# Fixed values.
SETTINGS = {
    "project": {"name": "trackweave", "version": __version__},
    "geometry": {"interpolate_distance": 50},
    "osm": {"timeout": 60, "endpoint": "https://overpass-api.de/api/interpreter"},
    "export": {"default_format": "xlsx"},
}


def get(*keys: str):
    """The setting at a path; KeyError where there is none."""
    found = SETTINGS
    for key in keys:
        found = found[key]
    return found
