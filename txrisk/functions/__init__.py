"""Column-expression builders (JVM-side, codegen-friendly)."""

from txrisk.functions.scalars import *  # noqa: F401,F403
from txrisk.functions.hashing import u01, hash32  # noqa: F401
