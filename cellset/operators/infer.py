"""Batch inference: user functions applied to cells and sets inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellset.operators.joins import parity
from cellset.session import materialize


def infer_cells(cells: DataFrame, fn: Callable, batch: int = 64, key: str = "cell_id", signed: bool = False) -> DataFrame:
    """Apply ``fn(indices, values, offsets) -> array[n, d]`` to ragged cells in batches of at most ``batch``.

    ``cells`` has ``key`` and ``entries``. The batch is handed over in compressed-row form. A vector that is not finite
    fails the job. With ``signed`` the result is written, and refused if the whole of it lacks negative or positive values.
    """
    kind = cells.schema[key].dataType.simpleString()
    rows = cells.select(key, F.transform("entries", lambda e: e.getField("gene")).alias("genes"),
                        F.transform("entries", lambda e: e.getField("count")).alias("counts"))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        for whole in batches:
            for start in range(0, whole.num_rows, batch):
                part = whole.slice(start, batch)
                genes, counts = part.column("genes"), part.column("counts")
                lengths = np.diff(np.asarray(genes.offsets))
                offsets = np.concatenate([[0], np.cumsum(lengths)])
                vectors = np.asarray(fn(genes.flatten().to_numpy(zero_copy_only=False),
                                        counts.flatten().to_numpy(zero_copy_only=False), offsets), dtype=np.float64)
                if vectors.shape[0] != part.num_rows or not np.isfinite(vectors).all():
                    raise ValueError("inference returned a wrong number of rows or values that are not finite")
                width = vectors.shape[1]
                flat = pa.array(vectors.ravel())
                ends = pa.array(np.arange(0, vectors.size + 1, width, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part.column(key), pa.ListArray.from_arrays(ends, flat)], [key, "vector"])

    out = rows.mapInArrow(run, f"`{key}` {kind}, vector array<double>")
    if not signed:
        return out
    table = materialize(out)
    ends = table.agg(F.min(F.array_min("vector")).alias("low"), F.max(F.array_max("vector")).alias("high")).first()
    if ends.low is not None and not ends.low < 0 < ends.high:
        raise ValueError("inference returned values of one sign only")
    return table


def _sets(sets: DataFrame, keys: list[str]) -> DataFrame:
    """Drawn sets as two matrices per row; a draw has a fixed size, so the lists are short."""
    side = lambda name: F.array_sort(F.collect_list(F.when(F.col("side") == name, F.struct(
        "cell_index", F.transform("v", lambda x: x.cast("double")).alias("v")))))
    table = sets.groupBy(*keys).agg(side("control").alias("_c"), side("treated").alias("_t"))
    flat = lambda c: F.flatten(F.transform(c, lambda m: m.getField("v")))
    return table.select(*keys, F.size("_c").alias("n_control"), flat("_c").alias("control"), F.size("_t").alias("n_treated"),
                        flat("_t").alias("treated"))


def _map_rows(table: DataFrame, keep: list[str], call: Callable) -> DataFrame:
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.select(*keep).schema)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        for part in batches:
            out = []
            for i in range(part.num_rows):
                get = lambda name, i=i: part.column(name)[i]
                vector = np.asarray(call(get), dtype=np.float64)
                if not np.isfinite(vector).all():
                    raise ValueError("inference returned values that are not finite")
                out.append(vector.ravel())
            yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keep], pa.array(out, pa.list_(pa.float64()))],
                                             [*keep, "vector"])

    return table.mapInArrow(run, f"{fields}, vector array<double>")


def infer_sets(sets: DataFrame, fn: Callable, keys: list[str]) -> DataFrame:
    """Apply ``fn(control[n, d], treated[m, d]) -> vector`` to drawn sets ``keys, side, cell_index, v``."""
    def call(get):
        matrix = lambda name, n: get(name).values.to_numpy(zero_copy_only=False).reshape(get(n).as_py(), -1)
        return fn(matrix("control", "n_control"), matrix("treated", "n_treated"))

    return _map_rows(_sets(sets, keys), keys, call)


def infer_transition(sets: DataFrame, fn: Callable, keys: list[str], drug: str, dose: str, dim: int) -> DataFrame:
    """Apply ``fn(control[n, d], drug id, dose) -> [n, d]``; the predicted set comes back as rows ``member, v``."""
    def call(get):
        control = get("control").values.to_numpy(zero_copy_only=False).reshape(get("n_control").as_py(), -1)
        return fn(control, get(drug).as_py(), get(dose).as_py())

    table = _sets(sets.where("side = 'control'"), [*keys, drug, dose])
    flat = _map_rows(table, [*keys, drug, dose], call)
    rows = F.transform(F.sequence(F.lit(0), (F.size("vector") / dim).cast("int") - 1), lambda i: F.slice("vector", i * dim + 1, dim))
    return flat.select(*keys, F.posexplode(rows).alias("member", "v"))


def check_deterministic(cells: DataFrame, fn: Callable, batch: int = 64, key: str = "cell_id") -> DataFrame:
    """Infer the same cells twice and compare."""
    limits = {"max_abs": 0.0, "mean_abs": 0.0, "max_relative_l2": 0.0, "min_cosine": -1.0}
    return parity(infer_cells(cells, fn, batch, key), infer_cells(cells, fn, batch, key), key, "vector", 0.0, 0.0, limits)
