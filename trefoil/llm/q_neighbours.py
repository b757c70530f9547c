"""Registered query of the nearest-neighbour search."""

from pyspark.sql import functions as F

from .common import table
from .neighbours import nearest
from .registry import query


@query("op8_vantage_point_neighbours")
def op8_vantage_point_neighbours(spark, folder):
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))
