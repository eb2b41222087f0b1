import math

from pyspark.sql import functions as F


def plan(df) -> str:
    """The executed physical plan as text."""
    return df._jdf.queryExecution().executedPlan().toString()


def value(spark, column, **fields):
    """One expression evaluated on one row of given fields."""
    row = spark.createDataFrame([tuple(fields.values())], [*fields])
    return row.select(column.alias("v")).first()["v"]


def softmax(z):
    top = max(z)
    e = [math.exp(x - top) for x in z]
    return [x / sum(e) for x in e]


def log_softmax(z):
    return [math.log(p) for p in softmax(z)]


def entropy(lp):
    return -sum(math.exp(x) * x for x in lp)


def decided(rows):
    """Rows of score lists to decisions as plain Python."""
    out = []
    for expert, z in enumerate(rows):
        lp = log_softmax(z)
        out.append((entropy(lp), expert, lp))
    return out


DECISIONS = "array<struct<h:double,expert:int,lp:array<double>>>"


def decisions_frame(spark, many):
    return spark.createDataFrame([(i, decided(rows)) for i, rows in enumerate(many)], f"id long, decisions {DECISIONS}")


def col(name):
    return F.col(name)
