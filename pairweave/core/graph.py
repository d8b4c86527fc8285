"""The user's graph: built edge by edge or loaded, inspected, and decoded by."""

from __future__ import annotations

import warnings
from numbers import Integral

import numpy as np

from ..functions.weights import MAX_WEIGHT, merge_probabilities, merge_weights
from ..sources import error_model
from .compiled import Compiled

STRATEGIES = ("disallow", "independent", "smallest-weight", "keep-original", "replace")


class Matching:
    """A weighted graph of nodes (detectors), edges with sets of fault ids, and a boundary.

    The graph is small next to the shots that are decoded with it: it lives on
    the driver, is compiled once after a change, and goes to executors as a
    broadcast (see ``operators.decode``).
    """

    def __init__(self, graph=None, weights=None, error_probabilities=None, repetitions=None, timelike_weights=None, measurement_error_probabilities=None, *, enable_correlations: bool = False, **kwargs):
        self._clear()
        graph = kwargs.pop("H", None) if graph is None else graph
        if graph is None:
            return
        if isinstance(graph, (error_model.ErrorModel, str)) or type(graph).__name__ == "DetectorErrorModel":
            self._load_model(graph, enable_correlations)
        elif hasattr(graph, "weighted_edge_list"):
            self.load_from_rustworkx(graph)
        elif hasattr(graph, "edges") and hasattr(graph, "nodes"):
            self.load_from_networkx(graph)
        elif type(graph).__name__ == "Circuit":
            self._load_model(graph.detector_error_model(decompose_errors=True), enable_correlations)
        elif isinstance(graph, (list, tuple, np.ndarray)) or hasattr(graph, "tocoo") or hasattr(graph, "toarray"):
            self.load_from_check_matrix(graph, weights, error_probabilities, repetitions, timelike_weights, measurement_error_probabilities, **kwargs)
        else:
            raise TypeError(f"the type of the graph isn't recognised: {type(graph)}")

    def _clear(self, num_nodes: int = 0, num_faults: int = 0) -> None:
        self._edges: list[list] = []  # node1, node2 or None, fault ids, weight, error probability
        self._at: dict[tuple, int] = {}
        self._boundary: set[int] = set()
        self._num_nodes, self._least_faults = num_nodes, num_faults
        self._rules: dict[tuple, list] = {}
        self._no_correlations = False
        self.coordinates: dict[int, tuple[float, ...]] = {}
        self._compiled: Compiled | None = None

    # building

    @staticmethod
    def _fault_ids(fault_ids, kwargs) -> set[int]:
        if fault_ids is not None and kwargs.get("qubit_id") is not None:
            raise ValueError("give fault_ids or qubit_id, which is its old name, not both")
        fault_ids = kwargs.get("qubit_id") if fault_ids is None else fault_ids
        if fault_ids is None:
            return set()
        if isinstance(fault_ids, Integral):
            return set() if fault_ids == -1 else {int(fault_ids)}
        return {int(x) for x in fault_ids}

    def add_edge(self, node1: int, node2: int, fault_ids=None, weight: float = 1.0, error_probability: float | None = None, *, merge_strategy: str = "disallow", **kwargs) -> None:
        if node1 < 0 or node2 < 0:
            raise ValueError("node ids must not be negative")
        self._add(int(node1), int(node2), self._fault_ids(fault_ids, kwargs), weight, error_probability, merge_strategy)

    def add_boundary_edge(self, node: int, fault_ids=None, weight: float = 1.0, error_probability: float | None = None, *, merge_strategy: str = "disallow", **kwargs) -> None:
        if node < 0:
            raise ValueError("node ids must not be negative")
        self._add(int(node), None, self._fault_ids(fault_ids, kwargs), weight, error_probability, merge_strategy)

    def _add(self, u: int, v: int | None, faults: set[int], weight: float, p: float | None, strategy: str) -> None:
        if strategy not in STRATEGIES:
            raise ValueError(f"merge strategy {strategy!r} isn't one of {', '.join(STRATEGIES)}")
        if abs(weight) > MAX_WEIGHT:
            warnings.warn(f"weight {weight} exceeds the maximum of {MAX_WEIGHT}; the edge isn't added", UserWarning, stacklevel=3)
            return
        self._put(u, v, faults, float(weight), -1.0 if p is None else float(p), strategy)

    def _put(self, u, v, faults, weight, p, strategy) -> None:
        key = (u, None) if v is None else (min(u, v), max(u, v))
        self._num_nodes = max(self._num_nodes, u + 1, (v or 0) + 1)
        old = self._edges[self._at[key]] if key in self._at else None
        if old is None:
            self._at[key] = len(self._edges)
            self._edges.append([u, v, set(faults), weight, p])
        elif strategy == "disallow":
            raise ValueError(f"edge ({u}, {v}) is there already; parallel edges need another merge strategy than disallow")
        elif strategy == "independent":
            old[3], old[4] = merge_weights(old[3], weight), merge_probabilities(old[4], p)
        elif strategy == "replace" or strategy == "smallest-weight" and weight < old[3]:
            old[2:] = [set(faults), weight, p]
        self._compiled = None

    def set_boundary_nodes(self, nodes) -> None:
        self._boundary = {int(x) for x in nodes}
        self._num_nodes = max([self._num_nodes, *(x + 1 for x in self._boundary)])
        self._compiled = None

    def ensure_num_fault_ids(self, min_num_fault_ids: int) -> None:
        self._least_faults = max(self._least_faults, int(min_num_fault_ids))
        self._compiled = None

    # loading

    @staticmethod
    def from_check_matrix(check_matrix, weights=None, error_probabilities=None, repetitions=None, timelike_weights=None, measurement_error_probabilities=None, *, faults_matrix=None, merge_strategy: str = "smallest-weight", use_virtual_boundary_node: bool = False, **kwargs) -> Matching:
        m = Matching()
        m.load_from_check_matrix(check_matrix, weights, error_probabilities, repetitions, timelike_weights, measurement_error_probabilities, faults_matrix=faults_matrix, merge_strategy=merge_strategy, use_virtual_boundary_node=use_virtual_boundary_node, **kwargs)
        return m

    def load_from_check_matrix(self, check_matrix=None, weights=None, error_probabilities=None, repetitions=None, timelike_weights=None, measurement_error_probabilities=None, *, faults_matrix=None, merge_strategy: str = "smallest-weight", use_virtual_boundary_node: bool = False, **kwargs) -> None:
        from ..sources.check_matrix import edges_of

        check_matrix = kwargs.get("H") if check_matrix is None else check_matrix
        if check_matrix is None:
            raise ValueError("no check matrix provided")
        edges, boundary = edges_of(check_matrix, weights, error_probabilities, repetitions, timelike_weights, measurement_error_probabilities, faults_matrix, use_virtual_boundary_node, kwargs)
        self._clear()
        if merge_strategy not in STRATEGIES:
            raise ValueError(f"merge strategy {merge_strategy!r} isn't one of {', '.join(STRATEGIES)}")
        for u, v, faults, w, p in edges:
            self._add(u, v, faults, w, p, merge_strategy)
        if boundary is not None and boundary < self._num_nodes:
            self.set_boundary_nodes({boundary})

    @staticmethod
    def from_detector_error_model(model, *, enable_correlations: bool = False) -> Matching:
        m = Matching()
        m._load_model(model, enable_correlations)
        return m

    @staticmethod
    def from_detector_error_model_file(path: str, *, enable_correlations: bool = False) -> Matching:
        return Matching.from_detector_error_model(error_model.read(path), enable_correlations=enable_correlations)

    @staticmethod
    def _analyse(circuit):
        try:
            import stim
        except ImportError as e:
            raise TypeError("circuits need the stim package, which isn't installed") from e
        if not isinstance(circuit, stim.Circuit):
            raise TypeError(f"`circuit` must be a stim circuit, not {type(circuit)}")
        return circuit.detector_error_model(decompose_errors=True)

    @staticmethod
    def from_stim_circuit(circuit, *, enable_correlations: bool = False) -> Matching:
        return Matching.from_detector_error_model(Matching._analyse(circuit), enable_correlations=enable_correlations)

    @staticmethod
    def from_stim_circuit_file(path: str, *, enable_correlations: bool = False) -> Matching:
        try:
            text = open(path, encoding="utf-8").read()  # noqa: SIM115
        except OSError as e:
            raise ValueError(f"could not open {path}: {e}") from e
        try:
            import stim
        except ImportError as e:
            raise TypeError("circuits need the stim package, which isn't installed") from e
        return Matching.from_stim_circuit(stim.Circuit(text), enable_correlations=enable_correlations)

    def _load_model(self, model, enable_correlations: bool) -> None:
        if not isinstance(model, error_model.ErrorModel):
            if not isinstance(model, str) and type(model).__name__ != "DetectorErrorModel":
                raise TypeError(f"a detector error model is needed, not {type(model)}")
            model = error_model.parse(str(model))
        self._clear(model.num_detectors, model.num_observables)
        self.coordinates = dict(model.coordinates)
        if not enable_correlations:
            for p, dets, obs in error_model.edge_errors(model):
                self._put(dets[0], dets[1] if len(dets) == 2 else None, set(obs), error_model.weight(p), p, "independent")
            self._no_correlations = True
            return
        from ..operators.correlated import implied_rules

        errors = list(error_model.checked_errors(model))
        for p, parts in errors:
            for dets, obs in parts:
                self._put(dets[0], dets[1] if len(dets) == 2 else None, set(obs), error_model.weight(p), p, "independent")
        self._rules = implied_rules(errors)

    @staticmethod
    def from_networkx(graph, *, min_num_fault_ids: int | None = None) -> Matching:
        m = Matching()
        m.load_from_networkx(graph, min_num_fault_ids=min_num_fault_ids)
        return m

    def load_from_networkx(self, graph, *, min_num_fault_ids: int | None = None) -> None:
        if not (hasattr(graph, "nodes") and hasattr(graph, "edges")) or hasattr(graph, "weighted_edge_list"):
            raise TypeError("a NetworkX graph is needed")
        self._load_objects(graph.nodes(data=True), graph.edges(data=True), min_num_fault_ids)

    @staticmethod
    def from_rustworkx(graph, *, min_num_fault_ids: int | None = None) -> Matching:
        m = Matching()
        m.load_from_rustworkx(graph, min_num_fault_ids=min_num_fault_ids)
        return m

    def load_from_rustworkx(self, graph, *, min_num_fault_ids: int | None = None) -> None:
        if not (hasattr(graph, "weighted_edge_list") and hasattr(graph, "nodes")):
            raise TypeError("a rustworkx graph is needed")
        self._load_objects(list(enumerate(graph.nodes())), graph.weighted_edge_list(), min_num_fault_ids)

    def load_from_retworkx(self, graph, *, min_num_fault_ids: int | None = None) -> None:
        warnings.warn("retworkx is now rustworkx; use load_from_rustworkx", DeprecationWarning, stacklevel=2)
        self.load_from_rustworkx(graph, min_num_fault_ids=min_num_fault_ids)

    def _load_objects(self, nodes, edges, min_num_fault_ids: int | None) -> None:
        rows = []
        for u, v, attrs in edges:
            attrs = attrs or {}
            if "fault_ids" in attrs and "qubit_id" in attrs:
                raise ValueError("edges have both fault_ids and qubit_id, its old name; use fault_ids only")
            faults = attrs.get("fault_ids", attrs.get("qubit_id", set()))
            if isinstance(faults, Integral) and not isinstance(faults, bool):
                faults = set() if faults == -1 else {int(faults)}
            else:
                try:
                    faults = set(faults)
                except TypeError as e:
                    raise TypeError(f"fault_ids must be an int or a set of ints, not {faults}") from e
                if not all(isinstance(x, Integral) for x in faults):
                    raise TypeError(f"fault_ids must be a set of ints, not {faults}")
            rows.append((int(u), int(v), faults, attrs.get("weight", 1), attrs.get("error_probability", -1)))
        nodes = list(nodes)
        self._clear(len(nodes))
        for u, v, faults, w, p in rows:
            self._add(u, v, faults, w, p, "smallest-weight")
        self.set_boundary_nodes({int(i) for i, attrs in nodes if attrs and attrs.get("is_boundary")})
        if min_num_fault_ids is not None:
            self.ensure_num_fault_ids(min_num_fault_ids)

    # looking

    def has_edge(self, node1: int, node2: int) -> bool:
        return (min(node1, node2), max(node1, node2)) in self._at

    def has_boundary_edge(self, node: int) -> bool:
        return (node, None) in self._at

    def _data(self, key) -> dict:
        if key not in self._at:
            raise ValueError(f"there is no edge {key}")
        _, _, faults, weight, p = self._edges[self._at[key]]
        return {"fault_ids": set(faults), "weight": weight, "error_probability": p}

    def get_edge_data(self, node1: int, node2: int) -> dict:
        return self._data((min(node1, node2), max(node1, node2)))

    def get_boundary_edge_data(self, node: int) -> dict:
        return self._data((node, None))

    def edges(self) -> list[tuple[int, int | None, dict]]:
        return [(u, v, {"fault_ids": set(f), "weight": w, "error_probability": p if 0 <= p <= 1 else -1.0}) for u, v, f, w, p in self._edges]

    @property
    def num_fault_ids(self) -> int:
        return max([self._least_faults, *(max(e[2]) + 1 for e in self._edges if e[2])])

    @property
    def boundary(self) -> set[int]:
        return set(self._boundary)

    @property
    def num_nodes(self) -> int:
        return self._num_nodes

    @property
    def num_edges(self) -> int:
        return len(self._edges)

    @property
    def num_detectors(self) -> int:
        return self._num_nodes - len(self._boundary)

    def is_boundary_node(self, node: int) -> bool:
        return node in self._boundary

    def all_edges_have_error_probabilities(self) -> bool:
        return all(0 <= e[4] <= 1 for e in self._edges)

    def max_abs_weight(self) -> float:
        return max((abs(e[3]) for e in self._edges), default=0.0)

    def get_edge_weight_normalising_constant(self) -> float:
        return self.compiled().scale

    def __repr__(self) -> str:
        def many(n: int, what: str) -> str:
            return f"{n} {what}{'s' * (n != 1)}"

        return f"<pairweave.Matching object with {many(self.num_detectors, 'detector')}, {many(len(self._boundary), 'boundary node')}, and {many(self.num_edges, 'edge')}>"

    # exporting

    def _export(self):
        virtual = any(e[1] is None for e in self._edges)
        nodes = [(i, i in self._boundary) for i in range(self._num_nodes)] + [(self._num_nodes, True)] * virtual
        return nodes, [(u, self._num_nodes if v is None else v, d) for u, v, d in self.edges()]

    def to_networkx(self):
        import networkx

        g = networkx.Graph()
        nodes, edges = self._export()
        for i, out in nodes:
            g.add_node(i, is_boundary=out)
        for u, v, d in edges:
            g.add_edge(u, v, **d)
        return g

    def to_rustworkx(self):
        import rustworkx

        g = rustworkx.PyGraph(multigraph=False)
        nodes, edges = self._export()
        g.add_nodes_from([{"is_boundary": out} for _, out in nodes])
        g.extend_from_weighted_edge_list(edges)
        return g

    def to_retworkx(self):
        warnings.warn("retworkx is now rustworkx; use to_rustworkx", DeprecationWarning, stacklevel=2)
        return self.to_rustworkx()

    def draw(self) -> str:
        """The graph as SVG text."""
        from ..sinks.drawing import svg

        return svg(self)

    def to_dataframes(self, spark):
        """(nodes, edges) as DataFrames; the node at the end of a boundary edge is null."""
        nodes = spark.createDataFrame([(i, i in self._boundary) for i in range(self._num_nodes)], "node long, is_boundary boolean")
        rows = [(i, u, v, sorted(f), w, p if 0 <= p <= 1 else None) for i, (u, v, f, w, p) in enumerate(self._edges)]
        return nodes, spark.createDataFrame(rows, "seq long, node1 long, node2 long, fault_ids array<long>, weight double, error_probability double")

    # decoding

    def compiled(self) -> Compiled:
        if self._compiled is None:
            self._compiled = Compiled(self._num_nodes, [tuple(e[:4]) for e in self._edges], frozenset(self._boundary), self.num_fault_ids, self._rules)
        return self._compiled

    def _checked(self, enable_correlations: bool) -> Compiled:
        if enable_correlations and self._no_correlations:
            raise ValueError("this model was loaded without correlations; load it with enable_correlations=True")
        return self.compiled()

    def _hits(self, z) -> np.ndarray:
        try:
            z = np.asarray(z).astype(np.uint8)
        except (ValueError, TypeError) as e:
            raise ValueError(f"a syndrome must be an array of numbers, not {z}") from e
        if z.ndim == 1 and self.num_detectors <= len(z) <= self.num_detectors + len(self._boundary):
            return np.flatnonzero(z)
        if z.ndim == 2 and z.size == self.num_detectors:
            times, checks = z.T.nonzero()
            return times * z.shape[0] + checks
        raise ValueError(f"a syndrome of shape {z.shape} doesn't fit this graph")

    def _bits(self, mask: int) -> np.ndarray:
        return np.array([mask >> i & 1 for i in range(self.num_fault_ids)], np.uint8)

    def decode(self, z, *, return_weight: bool = False, enable_correlations: bool = False, **_):
        own = self._checked(enable_correlations)
        hits = self._hits(z).tolist()
        mask, weight = own.decode_correlated(hits) if enable_correlations else own.decode(hits)
        return (self._bits(mask), weight / own.scale) if return_weight else self._bits(mask)

    def decode_batch(self, shots, *, return_weights: bool = False, bit_packed_shots: bool = False, bit_packed_predictions: bool = False, enable_correlations: bool = False):
        """Predictions of the rows of an array of shots, on the driver; for DataFrames of shots see ``operators.decode``."""
        own = self._checked(enable_correlations)
        shots = np.asarray(shots)
        if shots.ndim != 2:
            raise ValueError(f"shots need two dimensions, not {shots.ndim}")
        low, high = ((self.num_detectors + 7) // 8, (self.num_nodes + 7) // 8) if bit_packed_shots else (self.num_detectors, self.num_nodes)
        if not low <= shots.shape[1] <= high:
            raise ValueError(f"shots need from {low} to {high} columns, not {shots.shape[1]}")
        bits = np.unpackbits(shots.astype(np.uint8), axis=1, bitorder="little") if bit_packed_shots else shots
        solve = own.decode_correlated if enable_correlations else own.decode
        found = [solve(np.flatnonzero(row).tolist()) for row in bits]
        out = np.array([self._bits(m) for m, _ in found], np.uint8).reshape(len(found), self.num_fault_ids)
        if bit_packed_predictions:
            out = np.packbits(out, axis=1, bitorder="little")
        return (out, np.array([w / own.scale for _, w in found])) if return_weights else out

    def decode_to_edges_array(self, syndrome, *, enable_correlations: bool = False) -> np.ndarray:
        own = self._checked(enable_correlations)
        hits = self._hits(syndrome).tolist()
        found = own.decode_edges_correlated(hits) if enable_correlations else own.decode_edges(hits)
        return np.array(found, np.int64).reshape(-1, 2)

    def decode_to_matched_dets_array(self, syndrome) -> np.ndarray:
        return np.array(self.compiled().decode_pairs(self._hits(syndrome).tolist()), np.int64).reshape(-1, 2)

    def decode_to_matched_dets_dict(self, syndrome) -> dict[int, int | None]:
        out: dict[int, int | None] = {}
        for u, v in self.decode_to_matched_dets_array(syndrome).tolist():
            out[u] = None if v == -1 else v
            if v != -1:
                out[v] = u
        return out

    def get_nodes_on_shortest_path(self, node1: int | None, node2: int | None) -> list[int | None]:
        """The nodes from one to the other on a cheapest path over absolute weights; None or a boundary node is the boundary."""
        own = self.compiled()
        u, v = (None if x is None or x in self._boundary else x for x in (node1, node2))
        for x in (u, v):
            if x is not None and not 0 <= x < self._num_nodes:
                raise ValueError(f"node {x} isn't in this graph")
        if u is None and v is None:
            raise ValueError("a path needs an end that isn't the boundary")
        from ..operators.paths import shortest_path

        return shortest_path(own, u, v)

    def add_noise(self, rng: np.random.Generator | None = None):
        """(fault parities, syndrome) of one sample of independent edge errors, or None if an edge has no probability."""
        from ..operators.sampling import sample

        return sample(self, rng) if self.all_edges_have_error_probabilities() else None


