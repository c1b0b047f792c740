"""Training-data operators: text quality, deduplication, formatting, packing.

Each module holds one operator with its own general interface; ``queries``
registers them for the driver.  Nothing else in the library imports this
package.  Its functions are pickled by value, so that executors need no copy
of the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
