"""Bands, classes and table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

BANDS = ["g", "r", "i", "z"]

#: Class names and their codes.
CLASS_CODES = {"Ia": 1, "II": 2, "Ibc": 3, "IIn": 21, "IIP": 22, "IIL": 23, "Ib": 32, "Ic": 33}

#: Class codes and the target they stand for, by task.
TARGETS = {
    "binary": {1: 0, 2: 1, 3: 1, 21: 1, 22: 1, 23: 1, 32: 1, 33: 1},
    "three_way": {1: 0, 2: 1, 21: 1, 22: 1, 23: 1, 3: 2, 32: 2, 33: 2},
    "subtype": {1: 0, 21: 1, 22: 2, 23: 3, 32: 4, 33: 5, 3: 6},
}

OBSERVATIONS = T.StructType(
    [
        T.StructField("object_id", T.LongType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("t", T.DoubleType()),
        T.StructField("band", T.StringType()),
        T.StructField("flux", T.DoubleType()),
        T.StructField("flux_err", T.DoubleType()),
    ]
)


def flat_rows(with_host: bool = False) -> T.StructType:
    """Flat training rows: one per object and epoch."""
    fields = [T.StructField("object_id", T.LongType())]
    doubles = ["t", "ra", "decl", "mwebv", *(["hostz"] if with_host else []), *BANDS, *(f"{b}_err" for b in BANDS), "sim_z"]
    fields += [T.StructField(d, T.DoubleType()) for d in doubles]
    return T.StructType([*fields, T.StructField("class_code", T.IntegerType())])


PREDICTIONS = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("object_id", T.LongType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("pred", T.IntegerType()),
    ]
)

RESULTS = T.StructType(
    [
        T.StructField("model", T.StringType()),
        *(T.StructField(k, T.DoubleType()) for k in ("precision", "recall", "f1_score", "roc_auc")),
        T.StructField("best_params", T.MapType(T.StringType(), T.StringType())),
    ]
)
