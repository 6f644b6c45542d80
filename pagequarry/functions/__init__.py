"""Column and table functions.

The Arrow steps travel to the executors with their code, so a cluster needs no copy of this
package on its Python path.
"""

from pyspark import cloudpickle

from pagequarry.functions import dom, markup

cloudpickle.register_pickle_by_value(markup)
cloudpickle.register_pickle_by_value(dom)
