"""pairweave: minimum-weight matching with a boundary, as Spark DataFrames."""

from .core.graph import Matching
from .operators.sampling import rand_float, randomize, set_seed

__all__ = ["Matching", "rand_float", "randomize", "set_seed"]
