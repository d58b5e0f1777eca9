"""Every query of the library by name, and its SQL."""

from papyra.plans import narrative, persisting, records, relational, story, texts, vectors  # noqa: F401  they register their queries
from papyra.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
