"""Layers in several files."""

from pyspark.sql import functions as F

from dispatchlake.sources import feeds, sinks


def test_a_layer_in_files_of_few_features_is_read_whole(spark, tmp_path):
    at = F.struct(F.lit("Point").alias("type"), F.array(F.lit(-83.0), F.col("id") / 4).alias("coordinates"))
    rows = spark.range(103).select(F.col("id").alias("k"), F.struct(F.lit("Feature").alias("type"), F.create_map(F.lit("Firehouse"), F.concat(F.lit('E "'), F.col("id").cast("string"))).alias("properties"), at.alias("geometry")).alias("f"))
    path = str(tmp_path / "stations.geojson")
    sinks.write_layer(rows.repartition(7), "k", path, most=10)
    assert len(list((tmp_path / "stations.geojson").glob("part-*"))) == 11
    got = feeds.stations(feeds.geojson(spark, path)).orderBy("ord").collect()
    assert [(r.ord, r.name, r.lat, r.lng) for r in got] == [(i, f'E "{i}', i / 4, -83.0) for i in range(103)]
