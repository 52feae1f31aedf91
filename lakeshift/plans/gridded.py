"""Gridded NRT update (D9): append a new month to the history, analyse it and
tag every lake with its grid cell, as one job partitioned by lake.

The reference loops over grid cells, merging and analysing one cell at a
time and skipping cells already written; here the cell is just a column
(arithmetic key, J10) and ``done_cells`` is an anti join (T3).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..family import ID, Family, detect_family
from ..operators.geo import assign_grid_cell
from ..operators.merge import merge_append
from ..operators.nrt import nrt_breaks
from ..operators.panel import prepare
from ..session import written


def gridded_nrt(history: DataFrame, new_month: DataFrame, lakes: DataFrame, analysis_date: str,
                dlon: float = 10.0, dlat: float = 2.0, family: Family | None = None,
                done_cells: DataFrame | None = None, validate: bool = False, forecast: str = "ar1") -> DataFrame:
    family = family or detect_family(history)
    # written: the centroids are computed once, and the cells are read twice
    cells = written(assign_grid_cell(lakes.select(ID, "rings"), dlon, dlat).select(ID, "cell_lon", "cell_lat"), "cells")
    if done_cells is not None:
        cells = cells.join(done_cells.select("cell_lon", "cell_lat"), ["cell_lon", "cell_lat"], "left_anti")
    panel = merge_append(history, new_month, how="date", validate=validate)
    panel = panel.join(cells.select(ID), ID, "left_semi")
    result = nrt_breaks(prepare(panel, family), family, analysis_date, forecast=forecast)
    return cells.join(result, ID, "inner").select("cell_lon", "cell_lat", *result.columns)
