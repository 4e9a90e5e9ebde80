"""Named dashboard presets as filter specs."""

from __future__ import annotations

from lumenlake.constants import BLURRY_FROM, LARGE_VIDEO_FROM
from lumenlake.operators.specs import Spec, filters_to_spec

# fixed values: filters behind the preset names
PRESETS = {
    "screenshots": {"screenshot": True},
    "photos": {"mediaTypes": ["photo"]},
    "videos": {"mediaTypes": ["video"]},
    "favorites": {"favorite": True},
    "similar-photos": {"mediaTypes": ["photo"], "similar": True},
    "blurry-photos": {"mediaTypes": ["photo"], "minBlur": BLURRY_FROM},
    "large-videos": {"mediaTypes": ["video"], "minFileSize": LARGE_VIDEO_FROM},
}


def preset(name: str, before: int | None = None) -> Spec:
    """Spec of a preset, optionally only for assets older than a bound. Favorites are not excluded."""
    filters = dict(PRESETS[name])
    if before is not None:
        filters["before"] = before
    return filters_to_spec(filters, exclusions={"favorites": False})
