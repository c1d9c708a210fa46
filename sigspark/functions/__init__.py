"""Column expressions: identifiers, alteration names, guarded arithmetic and reproducible random numbers."""

from .columns import *  # noqa: F403
from .draws import *  # noqa: F403
