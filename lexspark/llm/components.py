"""Connected components, as the core has them."""

from lexspark.operators.graph import components  # noqa: F401
