"""Presets of five regions. Their polygons come from GeoJSON files, see sources.readers.region."""

from __future__ import annotations

from itertools import product

from seaweft.operators.tuning import Trial
from seaweft.plans.pipeline import Region

_FEW_GAMMAS = (1e-4, 5e-4, 1e-3, 2e-3, 5e-3, 1e-2, 2e-2, 5e-2)

#: Clustering parameters, expected ports, points that make a port, gammas and weights of each region.
REGIONS = {
    1: Region("region_1", ports=(30, 100), trial=Trial(1400, 1e-5, 4), weights=tuple(product((0.5, 1.0, 1.5, 2.0), repeat=2))),
    2: Region("region_2", ports=(10, 50), trial=Trial(500, 3e-4, 8), min_port_points=50, gammas=_FEW_GAMMAS),
    3: Region("region_3", ports=(30, 100), trial=Trial(200, 1e-4, 8), gammas=_FEW_GAMMAS),
    4: Region("region_4", ports=(30, 200), trial=Trial(1400, 1e-5, 4), gammas=_FEW_GAMMAS),
    5: Region("region_5", ports=(30, 200), trial=Trial(1400, 1e-5, 4), gammas=_FEW_GAMMAS),
}
