"""Document memory analytics expressed as Spark DataFrames.

Every operator is a function ``DataFrame -> DataFrame`` (or ``Column -> Column``);
nothing here holds the corpus in the driver.  See the README for a map from the
operator inventory to the modules.
"""

from .config import Settings
from .session import build_session

__all__ = ["Settings", "build_session"]
