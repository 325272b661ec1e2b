"""The codecs as SQL functions, Arrow batch by batch."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from bitloom.functions import codecs


def _each(f):
    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda d: None if d is None else f(bytes(d)))

    return F.pandas_udf(run, "binary")


def register(spark: SparkSession) -> None:
    """encode_blob, decode_blob, and for each byte codec NAME: NAME_encode and NAME_decode, of binary to binary; null
    gives null."""
    spark.udf.register("encode_blob", _each(codecs.encode))
    spark.udf.register("decode_blob", _each(codecs.decode))
    for name, (put, get) in codecs.BYTES.items():
        spark.udf.register(f"{name}_encode", _each(put))
        spark.udf.register(f"{name}_decode", _each(get))
