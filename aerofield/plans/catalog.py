"""All registered queries."""
from aerofield.plans import (  # noqa: F401
    queries_lines, queries_maps, queries_models, queries_series, queries_spectra, queries_streams)
from aerofield.plans.queries_models import flagship  # noqa: F401
from aerofield.plans.registry import ENTRIES  # noqa: F401
