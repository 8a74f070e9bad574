import pyarrow as pa
from pyspark.sql import functions as F, types as T

from encore.llm import frames


def test_long_texts_do_not_meet_in_one_batch(spark):
    texts = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("text"))
    schema = T.StructType([frames.field("bytes", frames.LONG)])

    def run(batches):
        for batch in batches:
            yield [pa.array([batch.nbytes])]

    sizes = [r["bytes"] for r in frames.map_batches(texts, schema, run).collect()]
    assert sum(sizes) > 40_000_000 and max(sizes) < 10_000_000
