"""Connected components; they stand with the functions, as other operators use them too."""

from ..functions.components import components  # noqa: F401
