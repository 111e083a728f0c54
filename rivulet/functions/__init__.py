"""Column-level helpers: loose coercion, truthiness, natural sort keys,
glob and regex translation, and the expression vocabulary (F-1 … F-23)."""

from rivulet.functions.coerce import (
    num, truthy, natural_key, glob_to_regex, intval, translate_regex,
    named_groups, as_column, template,
)
from rivulet.functions import vocab

__all__ = [
    "num", "truthy", "natural_key", "glob_to_regex", "intval", "translate_regex",
    "named_groups", "as_column", "template", "vocab",
]
