"""The name among the corpus operators of :mod:`windrow.functions.batches`."""

import sys

from windrow.functions import batches

sys.modules[__name__] = batches
