"""Turn file trees and stored web pages into grouped markdown documents with Spark."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
