"""Ranges as a large table would have them, where adaptive execution would make one."""

from pyspark.sql import functions as F

from barloom.operators import lookup
from barloom.session import materialized


def cut_into(monkeypatch, n):
    def in_pieces(df, keys, order):
        return materialized(df.repartitionByRange(n, *keys, *order).withColumn("_piece", F.spark_partition_id()))

    monkeypatch.setattr(lookup, "in_pieces", in_pieces)
