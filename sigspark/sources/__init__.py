"""Reading study files into long frames, and writing results."""

from .readers import *  # noqa: F403
from .writers import *  # noqa: F403
