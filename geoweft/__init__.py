"""Config-driven geodata pipelines as Spark DataFrame transforms."""
from pyspark import cloudpickle

from .functions import kernels, planar, wkb
from .operators import chains, http, lines, overlay
from .plans import pipeline, spec
from .sources import gpkg, services

# The few Python kernels travel to the executors with the job, so a cluster needs no install.
for _module in (kernels, planar, wkb, chains, overlay, lines, http, services, gpkg):
    cloudpickle.register_pickle_by_value(_module)

load = spec.load
run = pipeline.run
PipelineRun = pipeline.PipelineRun

__all__ = ["PipelineRun", "load", "run"]
