"""clickscore: product-usage telemetry x satisfaction-survey analytics on Spark.

Every public operator is a ``DataFrame (+ parameters) -> DataFrame`` function.
Work is expressed with the DataFrame API so Catalyst/AQE plan it; the only
driver-side steps are constant-size algebra (a <=16x16 solve, an 11x11
inverse, scalar distribution tails).
"""

from clickscore.session import get_spark, ensure_checkpoint_dir

__all__ = ["get_spark", "ensure_checkpoint_dir"]
