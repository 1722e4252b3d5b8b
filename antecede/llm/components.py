"""Connected components of a link table; the operators here share the library's."""

from antecede.operators.components import FEW_LINKS, components, least_labels

__all__ = ["FEW_LINKS", "components", "least_labels"]
