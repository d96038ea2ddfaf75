"""All registered checks (importing the modules registers them)."""

from dealscreen.checks import ORACLES, QUERIES  # noqa: F401
from dealscreen.checks import core  # noqa: F401
from dealscreen.checks import functions  # noqa: F401
from dealscreen.checks import sources  # noqa: F401
from dealscreen.checks import landing  # noqa: F401
from dealscreen.checks import chain  # noqa: F401
from dealscreen.checks import refresh  # noqa: F401
