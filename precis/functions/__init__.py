"""Column-level functions (JVM-side expressions unless noted)."""

from precis.functions.text import *  # noqa: F401,F403
from precis.functions.arrays import *  # noqa: F401,F403
