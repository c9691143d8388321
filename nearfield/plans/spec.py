"""What an index is made of, and which plan answers a query on it."""

from __future__ import annotations

from dataclasses import dataclass

from nearfield.functions import metrics

#: element type: bytes a value
TYPES = {"float": 4, "half": 2, "int8": 1, "int16": 2, "binary": 1 / 8}
#: allowed metrics by element type
PAIRS = {"float": {"l2", "ip"}, "half": {"l2", "ip"}, "int8": {"l2", "ip"}, "int16": {"l2", "ip"}, "binary": {"hamming"}}
KINDS = {"Flat", "Ivf", "IvfPQ", "PQFlat", "GroupIvf", "GroupIvfPq", "GroupHnsw", "RamVamana", "DiskVamana", "IvfRpq", "IvfFastScan"}
ALIASES = {"IvfFlat": "Ivf", "IvfPQFlat": "IvfPQ", "GroupIvfFlat": "GroupIvf"}


@dataclass(frozen=True)
class VectorSpec:
    dimension: int
    type: str = "float"
    metric: str = "l2"

    def __post_init__(self):
        if self.type not in TYPES:
            raise ValueError(f"unknown type {self.type}")
        if self.metric not in PAIRS[self.type]:
            raise ValueError(f"{self.metric} doesn't go with {self.type}")
        if self.dimension <= 0 or self.type == "binary" and self.dimension % 8:
            raise ValueError("a dimension is positive, and a multiple of 8 for bits")

    @property
    def element_size(self) -> int:
        return int(TYPES[self.type] * self.dimension)

    def kernel(self):
        name = {"l2": "squared_euclidean", "ip": "inner_product"}[self.metric]
        return metrics.KERNELS[("half_" if self.type == "half" else "") + name]


def index_kind(name: str) -> str:
    name = ALIASES.get(name, name)
    if name not in KINDS:
        raise ValueError(f"unknown index {name}")
    return name


def plan(kind: str, *, rows: int = 0, threshold: int = 0, recall_test: bool = False, coarse_ratio: float = 0.0, feeder=None, doc_feeder=None, reject=None) -> str:
    """exact, graph, ivf or pq; feeders come before filters, and a recall test over all slots is exact."""
    kind = index_kind(kind)
    if recall_test and coarse_ratio == 1:
        return "exact"
    if feeder is not None or doc_feeder is not None or reject is not None or kind == "Flat":
        return "exact"
    if kind == "GroupHnsw" and rows <= threshold:
        return "exact"
    if kind in ("GroupHnsw", "RamVamana", "DiskVamana"):
        return "graph"
    return "pq" if "PQ" in kind or "Pq" in kind or kind in ("IvfRpq", "IvfFastScan") else "ivf"


def from_factory(text: str) -> str:
    """The index kind that stands for a factory string such as ``IDMap,HNSW32`` or ``IVF100,PQ8``."""
    parts = [p for p in text.split(",") if p != "IDMap"]
    if any(p.startswith("HNSW") for p in parts):
        return "GroupHnsw"
    if any(p.startswith("IVF") for p in parts):
        return "IvfPQ" if any(p.startswith("PQ") for p in parts) else "Ivf"
    if any(p.startswith("PQ") for p in parts):
        return "PQFlat"
    if parts == ["Flat"]:
        return "Flat"
    raise ValueError(f"unknown factory string {text}")
