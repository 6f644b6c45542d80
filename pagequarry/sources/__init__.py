"""Tables and files. Reading steps travel to the executors with their code."""

from pyspark import cloudpickle

from pagequarry.sources import results

cloudpickle.register_pickle_by_value(results)
