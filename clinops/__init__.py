"""clinops — clinic-operations analytics as PySpark DataFrame transforms.

Every public function takes DataFrames (plus plain parameters such as an
explicit ``as_of``) and returns a DataFrame; nothing is collected to the
driver except tiny, size-bounded control values.
"""

from clinops.session import get_spark, ensure_checkpoint_dir

__all__ = ["get_spark", "ensure_checkpoint_dir"]
