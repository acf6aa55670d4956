"""Forest settings and search ranges of the twelve published models.

Keys read (response, cohort, province), the provinces shortened to their first letter.
"""

from __future__ import annotations

from coppice.operators.forest import ForestSpec


def _published(trees: int, mtry: int, min_node: int) -> ForestSpec:
    """As published: each tree on a bootstrap sample of its own, as deep as MLlib allows."""
    return ForestSpec(trees=trees, mtry=mtry, min_node=min_node, bags=trees, max_depth=30)


# Settings used for the final models.
FINAL_SPECS = {
    ("fines", "unburned", "K"): _published(trees=500, mtry=7, min_node=2),
    ("fines", "unburned", "C"): _published(trees=875, mtry=7, min_node=2),
    ("d50", "unburned", "K"): _published(trees=750, mtry=2, min_node=1),
    ("d50", "unburned", "C"): _published(trees=750, mtry=10, min_node=2),
    ("fines", "postfire", "K"): _published(trees=700, mtry=4, min_node=7),
    ("fines", "postfire", "C"): _published(trees=812, mtry=10, min_node=3),
    ("d50", "postfire", "K"): _published(trees=975, mtry=10, min_node=13),
    ("d50", "postfire", "C"): _published(trees=1325, mtry=5, min_node=1),
    ("fines", "difference", "K"): _published(trees=625, mtry=1, min_node=6),
    ("fines", "difference", "C"): _published(trees=875, mtry=12, min_node=2),
    ("d50", "difference", "K"): _published(trees=500, mtry=2, min_node=12),
    ("d50", "difference", "C"): _published(trees=812, mtry=10, min_node=3),
}

# Ranges of the regular search, five levels per parameter.
SEARCH_RANGES = {
    ("fines", "unburned", "C"): {"mtry": (5, 10), "min_n": (2, 10), "trees": (500, 1000)},
    ("fines", "unburned", "K"): {"mtry": (5, 10), "min_n": (2, 10), "trees": (500, 1000)},
    ("d50", "unburned", "C"): {"mtry": (5, 10), "min_n": (2, 10), "trees": (500, 1000)},
    ("d50", "unburned", "K"): {"mtry": (1, 8), "min_n": (1, 5), "trees": (500, 1000)},
    ("fines", "postfire", "C"): {"mtry": (6, 12), "min_n": (1, 10), "trees": (500, 1800)},
    ("fines", "postfire", "K"): {"mtry": (5, 12), "min_n": (2, 8), "trees": (500, 1000)},
    ("d50", "postfire", "C"): {"mtry": (5, 112), "min_n": (1, 8), "trees": (1200, 1700)},
    ("d50", "postfire", "K"): {"mtry": (10, 20), "min_n": (8, 15), "trees": (800, 1500)},
    ("fines", "difference", "C"): {"mtry": (6, 12), "min_n": (2, 10), "trees": (500, 1000)},
    ("fines", "difference", "K"): {"mtry": (1, 8), "min_n": (1, 8), "trees": (500, 1000)},
    ("d50", "difference", "C"): {"mtry": (6, 12), "min_n": (2, 10), "trees": (500, 1700)},
    ("d50", "difference", "K"): {"mtry": (1, 8), "min_n": (10, 20), "trees": (500, 1000)},
}
