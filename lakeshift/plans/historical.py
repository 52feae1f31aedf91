"""End-to-end historical run (D8): lakes of the run -> prepare -> detector -> geometry.

A run has one set of lakes: those that have both a polygon and panel rows
and, with a bounding box, their centroid inside it. The panel is filtered by
that set, prepared and analysed with a single exchange on the lake id, then
joined to the polygons of the same set and written once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..family import ID, Family, detect_family
from ..operators.breaks import all_breaks
from ..operators.geo import filter_bbox
from ..sinks.writers import write_breaks


def lakes_of_run(panel: DataFrame, lakes: DataFrame, bbox: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Panel and polygons, both of the lakes that are in the box and in both tables."""
    inside = filter_bbox(lakes, **bbox) if bbox else lakes
    known = inside.join(panel.select(ID).distinct(), ID, "left_semi")
    return panel.join(inside.select(ID).distinct(), ID, "left_semi"), known


def historical_breaks(panel: DataFrame, lakes: DataFrame | None = None, method: str = "simple",
                      family: Family | None = None, all_lakes: bool = True, bbox: dict | None = None,
                      **detector_kwargs) -> DataFrame:
    """Breaks of every lake of the run, joined to the polygons.

    ``all_lakes``: left join from the lakes of the run (those without a break
    have NULL columns); otherwise only lakes with a break. Without ``lakes``
    the run is the whole panel and the result has no polygons.
    """
    family = family or detect_family(panel)
    if lakes is None:
        return all_breaks(panel, method=method, family=family, **detector_kwargs)
    panel, lakes = lakes_of_run(panel, lakes, bbox)
    return lakes.join(all_breaks(panel, method=method, family=family, **detector_kwargs), ID,
                      "left" if all_lakes else "inner")


def run_historical(panel: DataFrame, lakes: DataFrame | None, out_path: str, method: str = "simple",
                   bbox: dict | None = None, geometry: bool = True, all_lakes: bool = False) -> None:
    """The breaks of ``historical_breaks`` written to ``out_path``, with or without polygons."""
    family = detect_family(panel)
    if lakes is not None:
        panel, lakes = lakes_of_run(panel, lakes, bbox)
    write_breaks(all_breaks(panel, method=method, family=family), lakes, out_path, geometry=geometry,
                 all_lakes=all_lakes)
