"""Composite operators. Each is a plain function DataFrame(s) -> DataFrame with
no actions inside (exceptions: ``models`` solves small systems on the driver
from one aggregated row per model, and sinks write)."""
