"""Before/after snapshots kept as JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Columns left out of a snapshot, out of the display, and out of the diff.
EXCLUDE = {"job": ("jd_raw_text",), "user": ("hashed_password",), "application": (), "resume": ()}
HEAVY_KEYS = ("match_details",)
NOISY_KEYS = ("updated_at",)


def to_snapshot(columns: list[str], kind: str) -> Column:
    """JSON of all columns but the excluded ones; nulls are kept."""
    kept = [c for c in columns if c not in EXCLUDE.get(kind, ())]
    return F.to_json(F.struct(*kept), {"ignoreNullFields": "false"})


def as_map(snapshot: Column) -> Column:
    return F.from_json(snapshot, "map<string,string>")


def changed_fields(before: Column, after: Column, noisy: tuple[str, ...] = NOISY_KEYS) -> Column:
    """Sorted keys whose value differs; a missing key equals null; empty on create and delete."""
    b, a = as_map(before), as_map(after)
    keys = F.array_except(F.array_union(F.map_keys(b), F.map_keys(a)), F.array(*[F.lit(k) for k in noisy]))
    differs = lambda k: ~F.try_element_at(b, k).eqNullSafe(F.try_element_at(a, k))
    return F.when(before.isNull() | after.isNull(), F.array().cast("array<string>")).otherwise(F.sort_array(F.filter(keys, differs)))


def strip_heavy(snapshot: Column, heavy: tuple[str, ...] = HEAVY_KEYS) -> Column:
    """The snapshot as a map without its bulky keys."""
    return F.map_filter(as_map(snapshot), lambda k, v: ~k.isin(*heavy))


def snap_field(before: Column, after: Column, key: str) -> Column:
    """A field from the later snapshot, else the earlier one; a JSON null falls through."""
    return F.coalesce(F.get_json_object(after, f"$.{key}"), F.get_json_object(before, f"$.{key}"))
