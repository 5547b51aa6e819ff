"""Sources and sinks (S1-S10): typed readers, writers, message-bus options."""

from txrisk.sources.io import *  # noqa: F401,F403
from txrisk.sources.kafka import *  # noqa: F401,F403
