"""The former place of weights, combination and cross-matching."""

import warnings

from ..operators.combine import STRATEGIES, WeightedCatalog, combine
from ..operators.match import MatchRules, cross_match
from ..operators.weights import Weight, default_weight

warnings.warn("astrolane.weight has moved to astrolane.operators", DeprecationWarning, stacklevel=2)

__all__ = ["STRATEGIES", "MatchRules", "Weight", "WeightedCatalog", "combine", "cross_match", "default_weight"]
