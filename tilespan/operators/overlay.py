"""Overlay of several tilings into one by a resolution spec."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hierarchy import unknown_labels
from ..functions.intervals import coalesce_runs, refine, track_mismatches
from ..functions.resolve import Spec, SpecError


def overlay(tracks: dict[str, DataFrame], spec: Spec) -> DataFrame:
    """seq_id, start, end, feature: the common refinement with resolved labels, equal neighbours joined. One shuffle by sequence, no range join."""
    refined = refine({n: tracks[n] for n in spec.precedence})
    return coalesce_runs(refined.select("seq_id", "start", "end", spec.column().alias("feature")))


def checked_overlay(tracks: dict[str, DataFrame], spec: Spec, edges: DataFrame | None = None) -> DataFrame:
    """overlay() after checks: the spec's featuresets are the tracks', labels are known, every sequence has all tracks over one span."""
    if set(tracks) != set(spec.precedence):
        raise SpecError(f"tracks {sorted(tracks)} and precedence {sorted(spec.precedence)} differ")
    if edges is not None:
        for name, rows in tracks.items():
            if wrong := unknown_labels(rows.select(F.lit(name).alias("feature_set"), "feature"), edges).limit(1).collect():
                raise ValueError(f"{name} has no label {wrong[0].feature}")
    if wrong := track_mismatches(tracks).limit(1).collect():
        raise ValueError(f"{wrong[0].seq_id}: {wrong[0].problem}")
    return overlay(tracks, spec)
