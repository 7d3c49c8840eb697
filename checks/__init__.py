"""Every query next to the SQL it must agree with.

``CATALOG`` maps a query name to its Spark function and, where SQL can say the same, its
SQL over the driver tables. ``__spark_entry__.py`` hands both to the driver.
"""

from checks.base import CATALOG
from checks import (  # noqa: F401  (each module fills the catalogue)
    captions,
    clusters,
    filters,
    layout,
    metrics,
    sampling,
    scalars,
    sources,
    subsets,
)

__all__ = ["CATALOG"]
