"""Signal cleaning and series analytics on Spark DataFrames."""

__version__ = "0.1.0"

from plumbline.functions.windows import Series  # noqa: E402
from plumbline.operators.shield import ModelShield  # noqa: E402
from plumbline.operators.stabilize import PRESETS, Stabilizer  # noqa: E402
from plumbline.operators.trigger import Shield  # noqa: E402

__all__ = ["PRESETS", "ModelShield", "Series", "Shield", "Stabilizer", "__version__"]
