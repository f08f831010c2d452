from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def docs(spark, texts, langs=None, sources=None, parts=3):
    """A documents table with ids 0, 1, ... (or (id, text) pairs)."""
    rows = []
    for i, t in enumerate(texts):
        k, t = t if isinstance(t, tuple) else (i, t)
        rows.append((k, t, langs[i] if langs else "en", sources[i] if sources else f"s{i % 3}", len(t or "")))
    return spark.createDataFrame(rows, DOCS).repartition(parts)
