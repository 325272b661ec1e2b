"""Command line: python -m bitloom inspect|analyze|encode|decode|bench PATH [options]."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from bitloom.operators import chunking, coding, planes, series
from bitloom.session import local_session
from bitloom.sources import blobs


def main() -> None:
    ask = argparse.ArgumentParser(prog="bitloom", description=__doc__)
    ask.add_argument("command", choices=["inspect", "analyze", "encode", "decode", "bench"])
    ask.add_argument("path", help="file or folder; for decode, the Parquet folder that encode wrote")
    ask.add_argument("--out", help="Parquet folder for the result; without it the rows are shown")
    ask.add_argument("--mode", choices=["auto", "recursive", "concatenated"], default="auto")
    ask.add_argument("--no-verify", action="store_true")
    ask.add_argument("--transitions", action="store_true")
    ask.add_argument("--summary", action="store_true")
    ask.add_argument("--log", action="store_true")
    for name in ("chunk-size", "frame-size", "width", "height"):
        ask.add_argument(f"--{name}", type=int, default=0)
    ask.add_argument("--channels", type=int, default=3)
    ask.add_argument("--target-chunks", type=int, default=16)
    a = ask.parse_args()
    spark = local_session()
    if a.command == "decode":
        df = coding.decoded(spark.read.parquet(a.path), not a.no_verify)
    else:
        data = blobs.files(spark, a.path)
        if a.command == "inspect":
            df = planes.levels(planes.ranked(planes.popcounts(planes.histogram(data)))).orderBy("source_id", "depth")
        elif a.command == "encode":
            df = coding.encoded(data, a.mode)
        elif a.command == "bench":
            df = coding.corpus(coding.compressor_bench(data)).orderBy("codec", "source_id")
        else:
            chunks = chunking.chunked(data, a.chunk_size, a.frame_size, a.width, a.height, a.channels, a.target_chunks)
            df = series.complexity(series.analysed(chunks))
            df = series.transitions(df) if a.transitions else series.summary(df) if a.summary else series.frame_log(df) if a.log else df
            df = df.orderBy(*(c for c in ("source_id", "index", "before") if c in df.columns))
    if a.out:
        df.write.mode("overwrite").parquet(a.out)
    else:
        df.select(*(F.hex(c).alias(c) if t == "binary" else c for c, t in df.dtypes)).show(1000, 120)


if __name__ == "__main__":
    main()
