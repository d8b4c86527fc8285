"""Check matrices: columns are edges, rows nodes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def columns_of(matrix, what: str) -> tuple[int, list[list[int]]]:
    """Number of rows, and for each column the rows with a one; explicit zeros don't count."""
    if hasattr(matrix, "tocoo"):
        coo = matrix.tocoo()
        shape, rows, cols, values = matrix.shape, np.asarray(coo.row), np.asarray(coo.col), np.asarray(coo.data)
    else:
        try:
            dense = np.asarray(matrix.toarray() if hasattr(matrix, "toarray") else matrix)
            dense = dense.astype(np.int64) if dense.size else dense.reshape(0, 0)
        except (TypeError, ValueError) as e:
            raise TypeError(f"the {what} can't be read as a matrix") from e
        if dense.ndim != 2:
            raise TypeError(f"the {what} needs two dimensions, not {dense.ndim}")
        shape = dense.shape
        rows, cols = dense.nonzero()
        values = dense[rows, cols]
    keep = values != 0
    if (values[keep] != 1).any():
        raise ValueError(f"the {what} must have ones only")
    out: list[list[int]] = [[] for _ in range(shape[1])]
    for r, c in sorted(zip(rows[keep].tolist(), cols[keep].tolist())):
        out[c].append(r)
    return shape[0], out


def _each(value, n: int, default: float, what: str, same: bool = True) -> list[float]:
    value = default if value is None else value
    if isinstance(value, (int, float, np.integer, np.floating)):
        return [float(value)] * n
    if not isinstance(value, (list, tuple, np.ndarray)):
        raise ValueError(f"{what} must be a number or a one-dimensional array")
    value = np.asarray(value, float)
    if value.ndim != 1 or len(value) != n:
        raise ValueError(f"{what} must have {n} values, not {value.shape}")
    return value.tolist()


def edges_of(matrix, weights=None, error_probabilities=None, repetitions=None, timelike_weights=None, measurement_error_probabilities=None, faults_matrix=None, virtual: bool = False, old_names: dict | None = None):
    """([(node1, node2 or None, fault ids, weight, error probability)], boundary node or None), in order of repetition and column, then time-like ones."""
    old = old_names or {}
    n, columns = columns_of(matrix, "check matrix")
    if weights is not None and old.get("spacelike_weights") is not None:
        raise ValueError("give weights or spacelike_weights, which is its old name, not both")
    if measurement_error_probabilities is not None and old.get("measurement_error_probability") is not None:
        raise ValueError("give measurement_error_probabilities or measurement_error_probability, which is its old name, not both")
    weights = _each(old.get("spacelike_weights") if weights is None else weights, len(columns), 1.0, "weights")
    p = _each(error_probabilities, len(columns), -1.0, "error_probabilities")
    if faults_matrix is None:
        faults = [{c} for c in range(len(columns))]
    else:
        faults = [set(x) for x in columns_of(faults_matrix, "faults matrix")[1]]
        if len(faults) != len(columns):
            raise ValueError(f"the faults matrix has {len(faults)} columns, the check matrix {len(columns)}")
    times = 1 if repetitions is None else repetitions
    bad = next((c for c, rows in enumerate(columns) if len(rows) > 2), None)
    if bad is not None:
        raise ValueError(f"column {bad} has {len(columns[bad])} ones; at most two are allowed")
    out, boundary = [], None
    end = n * times
    for t in range(times):
        for c, rows in enumerate(columns):
            if len(rows) == 2:
                out.append((rows[0] + n * t, rows[1] + n * t, faults[c], weights[c], p[c]))
            elif len(rows) == 1:
                out.append((rows[0] + n * t, None if virtual else end, faults[c], weights[c], p[c]))
                boundary = None if virtual else end
    if times > 1:
        step = _each(timelike_weights, n, 1.0, "timelike_weights")
        q = _each(old.get("measurement_error_probability") if measurement_error_probabilities is None else measurement_error_probabilities, n, -1.0, "measurement_error_probabilities")
        out += [(r + n * t, r + n * (t + 1), set(), step[r], q[r]) for t in range(times - 1) for r in range(n)]
    return out, boundary


def edges_from_coordinates(matrix: DataFrame, n_rows: int, repetitions: int = 1, faults: DataFrame | None = None, params: DataFrame | None = None, timelike: DataFrame | None = None, virtual: bool = True) -> DataFrame:
    """Edges of a check matrix given as rows (row, col, val), for matrices too large for the driver.

    ``faults`` has rows (fault, col), ``params`` (col, weight, error_probability),
    ``timelike`` (row, weight, error_probability).  A column of three ones or a
    value other than one stops the query.  Repetition replicates the merged
    columns by a generated sequence, not by a join.
    """
    ok = F.when(F.col("val") != 1, F.raise_error(F.lit("a check matrix must have ones only"))).otherwise(F.col("row"))
    columns = matrix.filter("val <> 0").select("col", ok.cast("long").alias("row")).groupBy("col").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    columns = columns.withColumn("rows", F.when(F.size("rows") > 2, F.raise_error(F.lit("a column of a check matrix has more than two ones"))).otherwise(F.col("rows")))
    if faults is None:
        columns = columns.withColumn("fault_ids", F.array(F.col("col").cast("long")))
    else:
        of = faults.groupBy("col").agg(F.sort_array(F.collect_set(F.col("fault").cast("long"))).alias("fault_ids"))
        columns = columns.join(of, "col", "left").withColumn("fault_ids", F.coalesce("fault_ids", F.expr("CAST(array() AS array<long>)")))
    if params is None:
        columns = columns.withColumns({"weight": F.lit(1.0), "error_probability": F.lit(None).cast("double")})
    else:
        columns = columns.join(params.select("col", "weight", "error_probability"), "col", "left")
    end = F.lit(None).cast("long") if virtual else F.lit(n_rows * repetitions).cast("long")
    t = F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))).alias("t")
    wide = columns.select(t, "col", "rows", "fault_ids", "weight", "error_probability")
    second = F.when(F.size("rows") == 2, F.get("rows", F.lit(1)) + F.col("t") * n_rows).otherwise(end)
    out = wide.select("t", F.col("col").cast("long").alias("col"), (F.get("rows", F.lit(0)) + F.col("t") * n_rows).alias("node1"), second.alias("node2"), "fault_ids", "weight", "error_probability")
    if timelike is not None and repetitions > 1:
        step = timelike.select(F.explode(F.sequence(F.lit(0), F.lit(repetitions - 2))).alias("t"), F.lit(None).cast("long").alias("col"), F.col("row").cast("long").alias("row"), "weight", "error_probability")
        out = out.unionByName(step.select("t", "col", (F.col("row") + F.col("t") * n_rows).alias("node1"), (F.col("row") + (F.col("t") + 1) * n_rows).alias("node2"), F.expr("CAST(array() AS array<long>)").alias("fault_ids"), "weight", "error_probability"))
    return out


def to_coordinates(spark: SparkSession, matrix) -> DataFrame:
    _, columns = columns_of(matrix, "check matrix")
    return spark.createDataFrame([(r, c, 1) for c, rows in enumerate(columns) for r in rows], "row long, col long, val int")
