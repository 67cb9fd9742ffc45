"""Sources and sinks."""

from precis.sources.tables import *  # noqa: F401,F403
from precis.sources.files import *  # noqa: F401,F403
