"""Names, keys and links."""

from __future__ import annotations

import difflib
import math
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def tile_of(grid_code: Column, mgrs_tile: Column, item_id: Column) -> Column:
    """Tile of a scene, however its source names it; the id where it doesn't."""
    return F.coalesce(grid_code, F.concat(F.lit("MGRS-"), mgrs_tile), item_id)


def public_link(href: Column) -> Column:
    """``s3://bucket/key`` as a public https link; others stay."""
    return F.regexp_replace(href, r"^s3://([^/]+)/+(.*)$", "https://$1.s3.amazonaws.com/$2")


def without_query(href: Column) -> Column:
    return F.regexp_replace(href, r"[?#].*$", "")


def suffix_of(href: Column) -> Column:
    """File suffix of a link's path, with its dot; empty if none."""
    return F.regexp_extract(without_query(href), r"[^/.](\.[^/.]+)$", 1)


def blob_account(href: Column) -> tuple[Column, Column]:
    """Account and container of a blob link, null for others."""
    host = F.parse_url(href, F.lit("HOST"))
    account = F.when(host.endswith(".blob.core.windows.net"), F.split_part(host, F.lit("."), F.lit(1)))
    return account, F.when(account.isNotNull(), F.split_part(F.parse_url(href, F.lit("PATH")), F.lit("/"), F.lit(2)))


def tile_key(*edges: Column) -> Column:
    """Stable name of a tile: 12 hex digits of the sha1 of its edges with six decimals."""
    return F.substring(F.sha1(F.concat_ws("_", *(F.format_string("%.6f", e) for e in edges))), 1, 12)


def by_state(band: str, state: str) -> str:
    return f"{band}_{state}"


def store_name(epsg: int) -> str:
    return f"mosaic_epsg{epsg}"


def nodata_text(value: float | None) -> str | None:
    """A nodata value as text for a descriptor."""
    return None if value is None else "nan" if math.isnan(value) else str(value)


def suggestion(name: str, known: Iterable[str]) -> str | None:
    """The only known name that contains ``name`` whatever the case, else the most similar one."""
    names = sorted(known)
    inside = [k for k in names if name.lower() in k.lower()]
    if len(inside) == 1:
        return inside[0]
    folded = {k.lower(): k for k in names}
    near = difflib.get_close_matches(name.lower(), folded, n=1, cutoff=0.3)
    return folded[near[0]] if near else None
