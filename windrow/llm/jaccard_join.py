"""The name among the corpus operators of :mod:`windrow.operators.jaccard_join`, which the flagship query shares."""

import sys

from windrow.operators import jaccard_join

sys.modules[__name__] = jaccard_join
