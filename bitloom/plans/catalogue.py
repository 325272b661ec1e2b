"""The registered queries, each over its whole table, and their DuckDB text where SQL can say the same."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.operators import chunking, coding, entropy, planes, positions, race, series
from bitloom.sources import blobs, generators
from bitloom.streaming import chunks as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The plane whose positions the gap and run queries look at (non-ASCII bytes), and that of the byte-wise queries.
BIT, LETTER_BIT = 7, 5
CHUNK = 2048
#: Frames of the page chunks: 16 x 16 pixels of 3 bytes.
FRAME = {"width": 16, "height": 16}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def rounded(df: DataFrame, *names: str, to: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, to) for n in names})


def source(table: str, key: str, text: str) -> str:
    """CTEs b (source_id, hx, n) and bytes (source_id, pos, v) of a text column."""
    return f"""b AS (SELECT CAST({key} AS VARCHAR) source_id, hex(encode(coalesce({text}, ''))) hx, CAST(octet_length(encode(coalesce({text}, ''))) AS BIGINT) n FROM {table}),
bytes AS (SELECT source_id, n, CAST(pos AS BIGINT) pos, CAST('0x' || h AS INTEGER) v FROM (SELECT source_id, n, unnest(range(n)) pos, unnest(regexp_extract_all(hx, '..')) h FROM b))"""


DOCS, BENCH, PAGES = source("documents", "doc_id", "text"), source("benchmark", "item_id", "text"), source("pages", "page_id", "html")
HIST = "hist AS (SELECT source_id, v, count(*) n FROM bytes GROUP BY ALL)"
POP = "pop AS (SELECT source_id, CAST(b AS INTEGER) bit, CAST(sum(CASE WHEN (v >> b) & 1 = 1 THEN n ELSE 0 END) AS BIGINT) flags, CAST(sum(n) AS BIGINT) n FROM hist, range(8) r(b) GROUP BY ALL)"
RANK = """ranked AS (SELECT source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY flags, bit) - 1 AS INTEGER) depth, bit, flags, n FROM pop),
ranks AS (SELECT r.source_id, r.depth, r.bit, CAST(r.bit - (SELECT count(*) FROM ranked x WHERE x.source_id = r.source_id AND x.depth < r.depth AND x.bit < r.bit) AS INTEGER) rank_bit, r.flags, r.n, r.flags / r.n density FROM ranked r)"""
POS = f"pos AS (SELECT source_id, n, pos FROM bytes WHERE (v >> {BIT}) & 1 = 1), gaps AS (SELECT source_id, n, pos, pos - lag(pos, 1, 0) OVER (PARTITION BY source_id ORDER BY pos) gap FROM pos)"
RUNS = """sets AS (SELECT source_id, n, min(pos) s, count(*) len FROM (SELECT *, pos - row_number() OVER (PARTITION BY source_id ORDER BY pos) g FROM pos) GROUP BY source_id, n, g),
ends AS (SELECT *, lag(s + len, 1, 0) OVER w AS bef, lead(s) OVER w AS nxt FROM sets WINDOW w AS (PARTITION BY source_id ORDER BY s)),
runs AS (SELECT * FROM (SELECT source_id, n, TRUE flagged, s AS start, len length FROM ends UNION ALL SELECT source_id, n, FALSE, bef, s - bef FROM ends UNION ALL SELECT source_id, n, FALSE, s + len, n - s - len FROM ends WHERE nxt IS NULL) WHERE length > 0)"""
SIZES = """g AS (SELECT source_id, max(n) n, count(*) k, max(gap) largest, max(pos) last FROM gaps GROUP BY 1),
r AS (SELECT source_id, CAST(sum(2 * (length(bin(length)) - 1) + 1) AS BIGINT) gamma FROM runs GROUP BY 1),
l AS (SELECT *, least(30, length(bin(n // k)) - 1) lo FROM g JOIN r USING (source_id)),
sizes AS (SELECT source_id, n, k, CAST(ceil(n / 8) AS BIGINT) bitset, CAST(4 + k * CASE WHEN largest <= 255 THEN 1 WHEN largest <= 65534 THEN 2 ELSE 4 END AS BIGINT) gap,
  CAST(17 + ceil(k * lo / 8) + ceil((k + (last >> lo)) / 8) AS BIGINT) ef, CAST(5 + ceil(gamma / 8) AS BIGINT) rle, CAST(k * lo + (n >> lo) + k AS BIGINT) ef_bits, CAST(8 + gamma AS BIGINT) rle_bits FROM l)"""
STRIDES = "[1, 2, 3, 4, 6, 8, 12, 16]"
LAGS = ", ".join(f"lag(v, {k}) OVER w" for k in entropy.STRIDES)
PAIRS = f"""lags AS (SELECT source_id, v, [{LAGS}] ctxs FROM bytes WINDOW w AS (PARTITION BY source_id ORDER BY pos)),
pairs AS (SELECT source_id, CAST(k AS INTEGER) k, ctx, sym, count(*) n FROM (SELECT source_id, unnest({STRIDES}) k, unnest(ctxs) ctx, v sym FROM lags) WHERE ctx IS NOT NULL GROUP BY ALL)"""
COND = """ctx AS (SELECT source_id, k, ctx, sum(n) n, sum(n * log2(n)) s FROM pairs GROUP BY ALL), cond AS (SELECT source_id, k, (sum(n * log2(n)) - sum(s)) / sum(n) h FROM ctx GROUP BY ALL UNION ALL SELECT source_id, CAST(k AS INTEGER), 8.0 FROM b, unnest([1, 2, 3, 4, 6, 8, 12, 16]) s(k) WHERE n <= k)"""


# Sources and chunks


@query("SELECT CAST(doc_id AS VARCHAR) source_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) size, sha256(coalesce(text, '')) sha256 FROM documents")
def blob_inventory(spark, sf_dir):
    return blobs.inventory(blobs.documents(spark, sf_dir))


def _chunk_sql(cte: str, size: str) -> str:
    return f"WITH {cte} SELECT source_id, CAST(c AS BIGINT) AS index, CAST(c * z AS BIGINT) AS offset, CAST(least(z, n - c * z) AS BIGINT) size, sha256(unhex(substr(hx, CAST(2 * c * z + 1 AS BIGINT), CAST(2 * z AS BIGINT)))) sha256 FROM (SELECT *, {size} z FROM b WHERE n > 0), unnest(range(CAST(ceil(n / z) AS BIGINT))) t(c)"


def _hashed(chunks: DataFrame) -> DataFrame:
    return chunks.select("source_id", "index", "offset", "size", F.sha2("data", 256).alias("sha256"))


@query(_chunk_sql(DOCS, str(CHUNK)))
def chunk_fixed(spark, sf_dir):
    return _hashed(chunking.chunked(blobs.documents(spark, sf_dir), chunk_size=CHUNK))


@query(_chunk_sql(PAGES, "768"))
def chunk_frames(spark, sf_dir):
    return _hashed(chunking.chunked(blobs.pages(spark, sf_dir), **FRAME))


@query(_chunk_sql(DOCS, "greatest(512, least(1048576, n // 16))"))
def chunk_adaptive_size(spark, sf_dir):
    return _hashed(chunking.chunked(blobs.documents(spark, sf_dir)))


# Planes


@query(f"WITH {DOCS}, {HIST}, {POP} SELECT source_id, bit, flags, n FROM pop")
def plane_popcount(spark, sf_dir):
    return planes.popcounts(planes.histogram(blobs.documents(spark, sf_dir)))


@query(f"WITH {DOCS}, {HIST}, {POP}, {RANK} SELECT source_id, depth, bit, rank_bit, flags, n, round(density, 6) density FROM ranks")
def plane_rank(spark, sf_dir):
    return rounded(planes.ranked(plane_popcount(spark, sf_dir)), "density")


@query(f"WITH {DOCS}, {HIST}, {POP} SELECT source_id, bit, flags FROM pop QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY flags, bit) = 1")
def sweep_winner(spark, sf_dir):
    return planes.sweep_winner(plane_popcount(spark, sf_dir))


def _level_sql(rest: str, one: str, before: str) -> str:
    return f"""WITH {DOCS}, {HIST}, {POP}, {RANK},
st AS (SELECT *, coalesce(sum(flags) OVER w, 0) AS lft, min(bit * 10000000000 + flags) OVER w AS low FROM ranks WINDOW w AS (PARTITION BY source_id ORDER BY depth ROWS BETWEEN {rest} FOLLOWING AND UNBOUNDED FOLLOWING)),
ov AS (SELECT *, coalesce(max(CASE WHEN lft = 0 OR (lft = n AND low % 10000000000 = n {one}) THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND {before}), 0) AS ovr FROM st)
SELECT source_id, depth, bit, rank_bit, flags, n, round(density, 6) density FROM ov WHERE ovr = 0"""


@query(_level_sql("0", "", "CURRENT ROW"))
def recursive_inspect(spark, sf_dir):
    return rounded(planes.levels(planes.ranked(plane_popcount(spark, sf_dir))), "density")


@query(_level_sql("1", "AND low < 10000000000", "1 PRECEDING"))
def concatenated_inspect(spark, sf_dir):
    return rounded(planes.levels(planes.ranked(plane_popcount(spark, sf_dir)), plain=True), "density")


@query(f"""WITH {DOCS}, {HIST}, m AS (SELECT *, v & ~(1 << {LETTER_BIT}) a, (v >> {LETTER_BIT}) & 1 f FROM hist),
q AS (SELECT *, ((a >> {LETTER_BIT + 1}) << {LETTER_BIT}) | (a & {(1 << LETTER_BIT) - 1}) r FROM m)
SELECT source_id, CAST(sum(a * n) AS BIGINT) aligned, CAST(sum(f * n) AS BIGINT) flags, CAST(sum(r * n) AS BIGINT) squeezed, CAST(0 AS BIGINT) wrong FROM q GROUP BY 1""")
def bit_clear_remap_roundtrip(spark, sf_dir):
    df = planes.histogram(blobs.documents(spark, sf_dir))
    df = df.withColumns({"a": planes.clear(F.col("v"), LETTER_BIT), "f": planes.flag(F.col("v"), LETTER_BIT)}).withColumn("r", planes.remap(F.col("a"), LETTER_BIT))
    back = planes.reconstruct(planes.unremap(F.col("r"), LETTER_BIT), F.col("f"), LETTER_BIT)
    total = lambda c: F.sum(c * F.col("n")).cast("long")
    return df.groupBy("source_id").agg(total(F.col("a")).alias("aligned"), total(F.col("f")).alias("flags"), total(F.col("r")).alias("squeezed"), total((back != F.col("v")).cast("int")).alias("wrong"))


def _aligned_and_flags(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    each = planes.bytes_of(blobs.benchmark(spark, sf_dir))
    flags = positions.flags(blobs.benchmark(spark, sf_dir), LETTER_BIT).select("source_id", "pos")
    return each.withColumn("aligned", planes.clear(F.col("v"), LETTER_BIT)), flags


@query(f"WITH {BENCH} SELECT source_id, pos, v AS aligned_or_flag FROM bytes")
def reconstruct_join(spark, sf_dir):
    aligned, flags = _aligned_and_flags(spark, sf_dir)
    back = planes.reconstruct(F.col("aligned"), F.coalesce("f", F.lit(0)), LETTER_BIT)
    return aligned.join(flags.withColumn("f", F.lit(1)), ["source_id", "pos"], "left").select("source_id", "pos", back.alias("aligned_or_flag"))


@query(f"WITH {BENCH} SELECT source_id, pos, v FROM bytes WHERE (v >> {LETTER_BIT}) & 1 = 1")
def flagged_semi(spark, sf_dir):
    aligned, flags = _aligned_and_flags(spark, sf_dir)
    return aligned.join(flags, ["source_id", "pos"], "left_semi").select("source_id", "pos", "v")


@query(f"WITH {BENCH} SELECT source_id, pos, v FROM bytes WHERE (v >> {LETTER_BIT}) & 1 = 0")
def unflagged_anti(spark, sf_dir):
    aligned, flags = _aligned_and_flags(spark, sf_dir)
    return aligned.join(flags, ["source_id", "pos"], "left_anti").select("source_id", "pos", "v")


@query(f"WITH {BENCH} SELECT source_id, pos, v FROM bytes WHERE FALSE")
def reconstruct_mismatches(spark, sf_dir):
    """Bytes that the reconstruction doesn't have: none."""
    back = reconstruct_join(spark, sf_dir).withColumnRenamed("aligned_or_flag", "v")
    return planes.bytes_of(blobs.benchmark(spark, sf_dir)).exceptAll(back)


@query(f"WITH {DOCS}, {HIST} SELECT source_id, count(*) distinct_bytes, bool_and(v = 0) all_zero, bool_and(v = 1) all_one, min(v) = max(v) all_same FROM hist GROUP BY 1")
def uniformity_predicates(spark, sf_dir):
    return planes.uniformity(planes.histogram(blobs.documents(spark, sf_dir)))


@query(f"WITH {BENCH}, w AS (SELECT source_id, pos // 8 q, CAST(sum(((v >> {LETTER_BIT}) & 1) << CAST(pos % 8 AS INTEGER)) AS BIGINT) x FROM bytes GROUP BY ALL) SELECT source_id, string_agg(lpad(hex(x), 2, '0'), '' ORDER BY q) bits FROM w GROUP BY 1")
def bitset_pack(spark, sf_dir):
    return planes.bitset(blobs.benchmark(spark, sf_dir), LETTER_BIT).withColumn("bits", F.hex("bits"))


@query(f"WITH {BENCH} SELECT source_id, count(*) flags, CAST(sum(pos) AS BIGINT) pos_sum FROM bytes WHERE (v >> {LETTER_BIT}) & 1 = 1 GROUP BY 1")
def popcount_words(spark, sf_dir):
    back = planes.unpacked(planes.bitset(blobs.benchmark(spark, sf_dir), LETTER_BIT))
    return back.groupBy("source_id").agg(F.count("*").alias("flags"), F.sum("pos").alias("pos_sum"))


@query(f"WITH {DOCS} SELECT source_id, CAST(m AS INTEGER) m, CAST(pos % m AS INTEGER) r, count(*) n, round(avg(v), 6) mean FROM bytes, unnest([3, 4, 6, 8, 12, 16]) t(m) GROUP BY ALL")
def modn_probe(spark, sf_dir):
    return rounded(entropy.modulo_probe(blobs.documents(spark, sf_dir)), "mean")


# Entropy


@query(f"WITH {DOCS}, {HIST} SELECT * FROM hist")
def byte_histogram(spark, sf_dir):
    return planes.histogram(blobs.documents(spark, sf_dir))


H0 = "h0 AS (SELECT source_id, CAST(sum(n) AS BIGINT) n, log2(sum(n)) - sum(n * log2(n)) / sum(n) h FROM hist GROUP BY 1)"


@query(f"WITH {DOCS}, {HIST}, {H0} SELECT source_id, n, round(h, 6) h FROM h0")
def order0_entropy(spark, sf_dir):
    return rounded(entropy.order0(byte_histogram(spark, sf_dir)), "h")


@query(f"WITH {DOCS}, {PAIRS} SELECT * FROM pairs WHERE k = 1")
def pair_histogram_k(spark, sf_dir):
    return entropy.pairs(blobs.documents(spark, sf_dir))


@query(f"WITH {DOCS}, {PAIRS}, {COND} SELECT source_id, k, round(h, 6) h FROM cond")
def cond_entropy_by_stride(spark, sf_dir):
    return rounded(entropy.by_stride(blobs.documents(spark, sf_dir)), "h")


@query(f"""WITH {DOCS}, {PAIRS.replace("FROM bytes", f"FROM bytes WHERE pos < {entropy.SAMPLE_BYTES}")}, {COND}, c AS (SELECT source_id, k, round(h, 9) h FROM cond), m AS (SELECT source_id, min({{'h': h, 'k': k}}) m, min(h) FILTER (k = 1) h1 FROM c GROUP BY 1)
SELECT source_id, CASE WHEN h1 - m.h >= 0.05 THEN m.k ELSE 1 END k, round(CASE WHEN h1 - m.h >= 0.05 THEN m.h ELSE h1 END, 6) h, round(h1, 6) h1 FROM m""")
def stride_select(spark, sf_dir):
    cond = entropy.by_stride(blobs.documents(spark, sf_dir), sample=entropy.SAMPLE_BYTES)
    return rounded(entropy.stride(cond), "h", "h1")


@query(f"WITH {DOCS}, {PAIRS} SELECT source_id, k, ctx, CAST(sum(n) AS BIGINT) n, count(*) symbols FROM pairs WHERE k = 1 GROUP BY ALL HAVING sum(n) >= 32")
def context_support(spark, sf_dir):
    return entropy.supported(entropy.pairs(blobs.documents(spark, sf_dir)))


@query(f"""WITH {DOCS}, {PAIRS}, {HIST}, s AS (SELECT source_id, k, ctx, sum(n) cn FROM pairs WHERE k = 1 GROUP BY ALL HAVING sum(n) >= 32), w AS (SELECT source_id, v sym, n / sum(n) OVER (PARTITION BY source_id) p0 FROM hist)
SELECT p.source_id, p.k, p.ctx, p.sym, p.n, cn IS NULL fell_back, round(coalesce(p.n / cn, p0), 6) p FROM pairs p LEFT JOIN s USING (source_id, k, ctx) JOIN w ON w.source_id = p.source_id AND w.sym = p.sym WHERE p.k = 1""")
def context_fallback(spark, sf_dir):
    """Rounded as binary numbers, as the SQL does; the decimal notation of 41/640 would round up."""
    df = blobs.documents(spark, sf_dir)
    shares = entropy.with_fallback(entropy.pairs(df), planes.histogram(df))
    return shares.withColumn("p", F.round(F.col("p") * 1e6) / 1e6)


@query(f"""WITH {BENCH}, {HIST}, f AS (SELECT *, greatest(1, CAST(round_even(n * 16384 / sum(n) OVER (PARTITION BY source_id), 0) AS BIGINT)) f0 FROM hist),
o AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY f0 DESC, v) - 1 i, 16384 - sum(f0) OVER (PARTITION BY source_id) d, count(*) OVER (PARTITION BY source_id) m, count(*) FILTER (f0 > 1) OVER (PARTITION BY source_id) big FROM f)
SELECT source_id, v, n, CAST(CASE WHEN d >= 0 THEN f0 + d // m + CASE WHEN i < d % m THEN 1 ELSE 0 END WHEN -d <= big THEN f0 - CASE WHEN i < -d THEN 1 ELSE 0 END END AS BIGINT) f FROM o""")
def freq_normalise(spark, sf_dir):
    """Each symbol's frequency. The SQL knows surpluses of no more than one for each symbol above 1, as all here are."""
    return entropy.normalised(planes.histogram(blobs.benchmark(spark, sf_dir)))


@query(f"""WITH {DOCS}, {PAIRS}, p1 AS (SELECT * FROM pairs WHERE k = 1), pr AS (SELECT source_id, sym, sum(n) pn FROM p1 GROUP BY ALL), par AS (SELECT source_id, sym, pn / sum(pn) OVER (PARTITION BY source_id) p FROM pr), ch AS (SELECT *, n / sum(n) OVER (PARTITION BY source_id, ctx) c FROM p1)
SELECT source_id, k, ctx, round(sum(n * log2(c / p)) / 8, 6) gain FROM ch JOIN par USING (source_id, sym) GROUP BY ALL""")
def kl_gain_contexts(spark, sf_dir):
    return rounded(entropy.kl_gain(entropy.pairs(blobs.documents(spark, sf_dir))), "gain")


BITS = f"""{HIST}, {H0}, al AS (SELECT source_id, CAST(b AS INTEGER) bit, v & ~(1 << b) a, sum(n) n, sum(n * ((v >> b) & 1)) f FROM hist, range(8) r(b) GROUP BY ALL),
a AS (SELECT source_id, bit, sum(n) n, CAST(sum(f) AS BIGINT) flag_count, log2(sum(n)) - sum(n * log2(n)) / sum(n) aligned_h FROM al GROUP BY ALL),
t AS (SELECT a.*, h, flag_count / a.n flag_ratio, a.n * aligned_h aligned_bits FROM a JOIN h0 USING (source_id)),
u AS (SELECT *, n * CASE WHEN flag_ratio <= 0 OR flag_ratio >= 1 THEN 0 ELSE -flag_ratio * log2(flag_ratio) - (1 - flag_ratio) * log2(1 - flag_ratio) END layer_flag_bits FROM t),
bt AS (SELECT *, aligned_bits + layer_flag_bits - n * h net_bits, CASE WHEN n * h = 0 THEN 0 ELSE 100 * (aligned_bits + layer_flag_bits - n * h) / (n * h) END net_pct FROM u)"""


@query(f"""WITH {DOCS}, {BITS} SELECT source_id, bit, round(flag_ratio, 6) flag_ratio, flag_count, round(aligned_h, 6) aligned_h, round(aligned_bits, 3) aligned_bits, round(layer_flag_bits, 3) layer_flag_bits, round(net_pct, 4) net_pct FROM bt""")
def bit_entropy_table(spark, sf_dir):
    df = entropy.bit_table(byte_histogram(spark, sf_dir))
    df = rounded(rounded(rounded(df, "flag_ratio", "aligned_h"), "aligned_bits", "layer_flag_bits", to=3), "net_pct", to=4)
    return df.drop("net_bits", "verdict").withColumn("net_pct", F.col("net_pct") + 0.0)


@query(f"WITH {DOCS}, {BITS}, x AS (SELECT source_id, bit, round(net_pct, 6) + 0.0 p FROM bt) SELECT source_id, bit best_entropy_bit FROM x QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY p, bit) = 1")
def best_entropy_bit(spark, sf_dir):
    table = entropy.bit_table(byte_histogram(spark, sf_dir))
    return entropy.best_bit(table.withColumn("net_pct", F.round("net_pct", 6) + 0.0)).select("source_id", "best_entropy_bit")


# Positions


def _flags(spark, sf_dir) -> DataFrame:
    return positions.flags(blobs.documents(spark, sf_dir), BIT)


@query(f"""WITH {DOCS}, {POS}, st AS (SELECT source_id, count(*) k, min(gap) gap_min, max(gap) gap_max, avg(gap) mean, stddev_pop(gap) dev, coalesce(stddev_pop(gap) / nullif(avg(gap), 0), 0) cv, avg(CAST(gap = 1 AS INTEGER)) one FROM gaps GROUP BY 1)
SELECT source_id, k, gap_min, gap_max, round(mean, 2) gap_mean, round(dev, 4) gap_stddev, round(cv, 4) gap_cv, round(1 - cv / (1 + cv), 4) gap_uniformity, round(one, 4) leading_gap_pct FROM st""")
def gap_stats(spark, sf_dir):
    df = positions.gap_stats(positions.gaps(_flags(spark, sf_dir)))
    return rounded(rounded(df, "gap_mean", to=2), "gap_stddev", "gap_cv", "gap_uniformity", "leading_gap_pct", to=4)


@query(f"WITH {DOCS}, {POS}, c AS (SELECT source_id, gap, count(*) c FROM gaps GROUP BY ALL) SELECT source_id, round(abs(log2(sum(c)) - sum(c * log2(c)) / sum(c)), 4) spatial_entropy FROM c GROUP BY 1")
def gap_entropy(spark, sf_dir):
    df = positions.gap_entropy(positions.gaps(_flags(spark, sf_dir)))
    return df.withColumn("spatial_entropy", F.round(F.abs("spatial_entropy"), 4))


@query(f"WITH {DOCS}, {POS} SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY pos) nth, pos FROM pos")
def gap_roundtrip(spark, sf_dir):
    return positions.from_gaps(positions.gaps(_flags(spark, sf_dir))).select("source_id", F.col("nth").cast("long").alias("nth"), "pos")


@query(f"""WITH {DOCS}, {POS}, {RUNS} SELECT source_id, count(*) n_runs, coalesce(max(length) FILTER (flagged), 0) run_set_max, round(coalesce(avg(length) FILTER (flagged), 0), 6) run_set_mean, coalesce(max(length) FILTER (NOT flagged), 0) run_clear_max, round(coalesce(avg(length) FILTER (NOT flagged), 0), 6) run_clear_mean FROM runs GROUP BY 1""")
def run_stats(spark, sf_dir):
    df = rounded(positions.run_stats(positions.runs(_flags(spark, sf_dir))), "run_set_mean", "run_clear_mean")
    return df.withColumns({c: F.col(c).cast("long") for c in ("run_set_max", "run_clear_max")})


@query(f"WITH {DOCS}, {POS}, {RUNS}, {SIZES} SELECT * FROM sizes")
def flag_sizes(spark, sf_dir):
    """Closed-form sizes of bitset, gap list, Elias-Fano and run lengths, and theoretical bits."""
    return positions.sizes(_flags(spark, sf_dir))


@query(f"""WITH {DOCS}, {HIST}, {POP} SELECT source_id, bit, c fmt FROM pop, unnest(list_concat(['HUFFMAN', 'LZ77HUFF', 'RLE', 'BITSET'], CASE WHEN flags / n <= 0.30 THEN ['GAP', 'EF'] ELSE [] END, CASE WHEN flags / n BETWEEN 0.15 AND 0.85 THEN ['LZ77'] ELSE [] END)) t(c)""")
def candidate_formats(spark, sf_dir):
    return plane_popcount(spark, sf_dir).select("source_id", "bit", F.explode(race.candidates(F.col("flags") / F.col("n"))).alias("fmt"))


@query(f"""WITH {DOCS}, {POS}, {RUNS}, {SIZES}, c AS (SELECT source_id, rle sz, 2 pr, 'RLE' fmt FROM sizes UNION ALL SELECT source_id, bitset, 3, 'BITSET' FROM sizes UNION ALL SELECT source_id, gap, 4, 'GAP' FROM sizes WHERE k / n <= 0.3 UNION ALL SELECT source_id, ef, 5, 'EF' FROM sizes WHERE k / n <= 0.3)
SELECT source_id, fmt, sz bytes FROM c QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY sz, pr) = 1""")
def flag_race(spark, sf_dir):
    return race.winner(positions.sizes(_flags(spark, sf_dir)))


# Timelines


SERIES = f"""ck AS (SELECT source_id, pos // {CHUNK} AS index, v, count(*) n FROM bytes GROUP BY ALL), cp AS (SELECT source_id, index, CAST(b AS INTEGER) bit, sum(CASE WHEN (v >> b) & 1 = 1 THEN n ELSE 0 END) flags, sum(n) n FROM ck, range(8) r(b) GROUP BY ALL),
sr AS (SELECT source_id, CAST(index AS BIGINT) AS index, CAST(index * {CHUNK} AS BIGINT) AS offset, CAST(max(n) AS BIGINT) size, CASE WHEN max(flags) FILTER (bit = 7) = 0 THEN 'Plain text' WHEN max(flags / n) FILTER (bit = 7) > 0.05 THEN 'Accented noise' ELSE 'Mixed text' END cls, CAST(count(*) FILTER (flags / n > 0.4) AS INTEGER) halt_depth, arg_min(bit, flags * 10 + bit) primary_target_bit FROM cp GROUP BY source_id, index),
nx AS (SELECT *, lead(index) OVER w AS ni, lead("offset") OVER w AS noff, lead(cls) OVER w AS nc, lead(halt_depth) OVER w AS nh, lead(primary_target_bit) OVER w AS nb FROM sr WINDOW w AS (PARTITION BY source_id ORDER BY index)),
tr AS (SELECT source_id, index AS before, ni AS after, noff byte_offset, list_filter([CASE WHEN cls <> nc THEN 'class ' || cls || ' -> ' || nc END, CASE WHEN abs(nh - halt_depth) >= 3 THEN 'halt ' || halt_depth || ' -> ' || nh END, CASE WHEN primary_target_bit <> nb AND NOT (contains(cls, 'noise') AND contains(nc, 'noise')) THEN 'bit ' || primary_target_bit || ' -> ' || nb END], lambda x: x IS NOT NULL) reasons FROM nx WHERE ni IS NOT NULL)"""


def chunk_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A timeline whose rules SQL can repeat: classes by the share of non-ASCII bytes, depth by the dense planes."""
    chunks = chunking.fixed(blobs.documents(spark, sf_dir), CHUNK)
    pop = planes.popcounts(planes.histogram(chunks, "source_id", "index"), "source_id", "index")
    share = F.col("flags") / F.col("n")
    high = lambda c: F.max(F.when(F.col("bit") == 7, c))
    cls = F.when(high(F.col("flags")) == 0, "Plain text").when(high(share) > 0.05, "Accented noise").otherwise("Mixed text")
    agg = pop.groupBy("source_id", "index").agg(F.max("n").alias("size"), cls.alias("cls"), F.count_if(share > 0.4).cast("int").alias("halt_depth"), F.min(F.struct("flags", "bit"))["bit"].alias("primary_target_bit"))
    return agg.select("source_id", "index", (F.col("index") * CHUNK).alias("offset"), "size", "cls", "halt_depth", F.lit(None).cast("double").alias("l0_odd_ratio"), "primary_target_bit", F.lit(None).cast("int").alias("best_entropy_bit"), F.lit(None).cast("double").alias("best_entropy_pct"))


@query(f"WITH {DOCS}, {SERIES} SELECT source_id, index, \"offset\", size, cls, halt_depth, primary_target_bit FROM sr")
def timeline(spark, sf_dir):
    return series.complexity(chunk_series(spark, sf_dir)).select("source_id", "index", "offset", "size", "cls", "halt_depth", "primary_target_bit")


@query(f"WITH {DOCS}, {SERIES} SELECT source_id, before, after, byte_offset, array_to_string(reasons, '; ') reasons FROM tr WHERE len(reasons) > 0")
def transitions(spark, sf_dir):
    return series.transitions(series.complexity(chunk_series(spark, sf_dir))).withColumn("reasons", F.array_join("reasons", "; "))


@query(f"""WITH RECURSIVE {DOCS}, {SERIES.replace(">= 3", ">= 4")}, o AS (SELECT DISTINCT source_id, byte_offset FROM tr WHERE len(reasons) > 0), ol AS (SELECT source_id, list(byte_offset ORDER BY byte_offset) ats FROM o GROUP BY 1),
f AS (SELECT source_id, ats, CAST(0 AS BIGINT) last, 0 nth FROM ol UNION ALL SELECT source_id, ats, list_filter(ats, lambda x: x - last >= 4096)[1], nth + 1 FROM f WHERE list_filter(ats, lambda x: x - last >= 4096)[1] IS NOT NULL)
SELECT source_id, nth, last AS "offset" FROM f""")
def adaptive_boundaries(spark, sf_dir):
    return chunking.boundaries(series.transitions(series.complexity(chunk_series(spark, sf_dir)), series.CUT_STEP), min_size=4096)


@query(f"""WITH {DOCS}, {SERIES} SELECT source_id, count(*) n_chunks, CAST(sum(size) AS BIGINT) total_bytes, round(avg(halt_depth), 6) halt_depth_mean, min(halt_depth) halt_depth_min, max(halt_depth) halt_depth_max, count(*) FILTER (contains(lower(cls), 'noise')) n_noise_chunks, round(100.0 * count(*) FILTER (contains(lower(cls), 'noise')) / count(*), 6) compression_skip_pct FROM sr GROUP BY 1""")
def summary(spark, sf_dir):
    df = series.summary(series.complexity(chunk_series(spark, sf_dir)))
    return rounded(df, "halt_depth_mean", "compression_skip_pct").drop("class_distribution", "bit_distribution", "n_reduction_chunks")


@query(f"""WITH {DOCS}, {SERIES} SELECT cls, primary_target_bit, count(*) n_chunks FROM sr GROUP BY ALL""")
def class_bit_distribution(spark, sf_dir):
    maps = series.summary(series.complexity(chunk_series(spark, sf_dir)).withColumn("all", F.lit(1)).withColumn("source_id", F.concat_ws("|", "cls", "primary_target_bit")))
    each = maps.select("source_id", F.explode("class_distribution").alias("cls", "n_chunks"))
    return each.select("cls", F.element_at(F.split("source_id", r"\|"), 2).cast("int").alias("primary_target_bit"), "n_chunks")


@query("""WITH f AS (SELECT CAST(i // 12288 AS BIGINT) AS frame, CAST(i % 12288 AS BIGINT) pos, CAST((CAST(floor((i % 12288) * 255 / 12288) AS INTEGER) & 254) AS INTEGER) v FROM range(8 * 12288) t(i)) SELECT frame, count(*) n, CAST(sum(v) AS BIGINT) v_sum, count(DISTINCT v) distinct_v FROM f GROUP BY 1""")
def synthetic_video(spark, sf_dir):
    video = generators.synthetic_video(spark).where("frame < 8")
    return video.groupBy("frame").agg(F.count("*").alias("n"), F.sum("v").cast("long").alias("v_sum"), F.count_distinct("v").alias("distinct_v"))


@query("""WITH p AS (SELECT n FROM range(2, 20000) a(n) WHERE NOT EXISTS (SELECT 1 FROM range(2, 142) d(k) WHERE k * k <= n AND n % k = 0)) SELECT CAST(row_number() OVER (ORDER BY n) - 1 AS BIGINT) pos, CAST((lead(n) OVER (ORDER BY n) - n) % 256 AS INTEGER) v FROM p QUALIFY pos < 2048""")
def prime_gaps(spark, sf_dir):
    return generators.prime_gaps(spark, 2048)


@query("""WITH RECURSIVE f AS (SELECT CAST(0 AS BIGINT) pos, 0 v, 1 w UNION ALL SELECT pos + 1, w, (v + w) % 256 FROM f WHERE pos < 2047) SELECT pos, v FROM f""")
def fibonacci_bytes(spark, sf_dir):
    return generators.fibonacci(spark, 2048)


# What SQL cannot say; tests hold these against round trips and brute force.


@query()
def real_layers(spark, sf_dir):
    return series.decay(blobs.documents(spark, sf_dir), "source_id")


@query()
def fingerprint(spark, sf_dir):
    df = blobs.documents(spark, sf_dir)
    hist = planes.histogram(df)
    return series.fingerprint(series.decay(df, "source_id"), planes.popcounts(hist), planes.uniformity(hist))


@query()
def cutoff_plan(spark, sf_dir):
    """What the recursive format costs with the best stop, and that stop."""
    level = F.sort_array(F.collect_list(F.struct("depth", "flag_bytes", "ans_bytes")))
    df = coding.inspect_sizes(blobs.benchmark(spark, sf_dir)).groupBy("source_id").agg(level.alias("levels"), F.max("terminal").alias("terminal"))
    return df.select("source_id", F.size("levels").alias("n_levels"), race.cutoff(F.col("levels"), F.col("terminal")).alias("c")).select("source_id", "n_levels", "c.cost", "c.depth")


@query()
def encode_roundtrip_recursive(spark, sf_dir):
    return coding.roundtrip(blobs.benchmark(spark, sf_dir), "recursive")


@query()
def encode_roundtrip_concatenated(spark, sf_dir):
    return coding.roundtrip(blobs.benchmark(spark, sf_dir), "concatenated")


@query()
def encode_roundtrip_auto(spark, sf_dir):
    return coding.roundtrip(blobs.benchmark(spark, sf_dir))


@query()
def codec_roundtrip(spark, sf_dir):
    return coding.codec_roundtrip(blobs.benchmark(spark, sf_dir))


@query()
def flag_bench(spark, sf_dir):
    return coding.plane_roundtrip(blobs.benchmark(spark, sf_dir))


def _records(spark, sf_dir) -> DataFrame:
    df = chunking.fixed(blobs.benchmark(spark, sf_dir), 128)
    hist = planes.histogram(df, "source_id", "index")
    win = planes.sweep_winner(planes.popcounts(hist, "source_id", "index"), "source_id", "index").withColumnRenamed("bit", "target_bit")
    return coding.chunk_records(df.join(win, ["source_id", "index"]).withColumn("cls", F.lit("Structured")))


@query(f"WITH {BENCH} SELECT source_id, sha256(unhex(hx)) sha256 FROM b WHERE n > 0")
def chunk_container_roundtrip(spark, sf_dir):
    """Hash of each blob put together again from its chunk container."""
    parts = coding.chunk_contents(coding.chunk_containers(_records(spark, sf_dir)))
    whole = parts.groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct("index", "data"))).alias("p"))
    joined = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["data"])), ""))
    return whole.select("source_id", F.sha2(joined, 256).alias("sha256"))


@query()
def chunk_container_headers(spark, sf_dir):
    return coding.chunk_headers(coding.chunk_containers(_records(spark, sf_dir)))


@query()
def global_vs_chunked(spark, sf_dir):
    """Encoded whole against in chunks, and how many chunks go without a plane."""
    whole = coding.encoded(blobs.benchmark(spark, sf_dir)).select("source_id", "size", F.octet_length("container").cast("long").alias("whole"))
    chunked = _records(spark, sf_dir).groupBy("source_id").agg(F.sum("encoded").alias("chunked"), F.count("*").alias("n_chunks"), F.count_if(F.col("target_bit") == 255).alias("n_skip"))
    return whole.join(chunked, "source_id").withColumn("delta_pct", 100 * F.try_divide(F.col("chunked") - F.col("whole"), "whole"))


@query()
def corpus_rollup(spark, sf_dir):
    return coding.corpus(coding.compressor_bench(blobs.benchmark(spark, sf_dir)))


def _shared(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="bitloom-")
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"


@query(f"WITH {DOCS}, {SERIES} SELECT source_id, index, \"offset\", size FROM sr")
def stream_chunk_stats(spark, sf_dir):
    docs = blobs.table(spark, sf_dir, "documents")
    schema = ", ".join(f"{n} {t}" for n, t in docs.dtypes)
    # a pattern, for a stream of one file or of a folder of files alike
    stream = streaming.blob_stream(spark, f"{sf_dir}/documents.parque[t]", "doc_id", "text", schema)
    return streaming.drained(streaming.chunk_stats(stream, CHUNK), _shared(spark)).select("source_id", "index", "offset", "size")


@query(f"""WITH {PAGES}, t AS (SELECT source_id, lag(v, 2) OVER w c2, lag(v) OVER w c1, v sym, pos FROM bytes WINDOW w AS (PARTITION BY source_id ORDER BY pos)),
three AS (SELECT source_id, c2, c1, sym, count(*) n FROM t WHERE pos >= 2 GROUP BY ALL), two AS (SELECT source_id, c2, c1 FROM three GROUP BY ALL HAVING sum(n) >= 128), one AS (SELECT source_id, c1 FROM three GROUP BY ALL HAVING sum(n) >= 64)
SELECT source_id, CAST(level AS INTEGER) AS level, CAST(sum(n) AS BIGINT) symbols FROM (SELECT three.*, CASE WHEN two.c1 IS NOT NULL THEN 2 WHEN one.c1 IS NOT NULL THEN 1 ELSE 0 END AS level FROM three LEFT JOIN two ON two.source_id = three.source_id AND two.c2 = three.c2 AND two.c1 = three.c1 LEFT JOIN one ON one.source_id = three.source_id AND one.c1 = three.c1) GROUP BY ALL""")
def context_cascade(spark, sf_dir):
    return entropy.cascade(blobs.pages(spark, sf_dir)).groupBy("source_id", "level").agg(F.sum("n").alias("symbols"))


@query()
def backend_bench(spark, sf_dir):
    return coding.backend_bench(blobs.benchmark(spark, sf_dir))


@query()
def cost_based_bit(spark, sf_dir):
    return coding.bit_choices(blobs.benchmark(spark, sf_dir))


@query()
def flag_position_profile(spark, sf_dir):
    df = blobs.documents(spark, sf_dir)
    return positions.profile(df, BIT, coding.compressed_flags(df, BIT))


@query()
def sweep_totals(spark, sf_dir):
    return series.sweep_totals(blobs.documents(spark, sf_dir)).withColumn("layers", F.array_join("layers", ","))


@query()
def complexity_series(spark, sf_dir):
    """The whole analysis of chunks: fingerprint, target bits and entropies."""
    return series.complexity(series.analysed(chunking.fixed(blobs.documents(spark, sf_dir, even=True), CHUNK)))


@query()
def frame_log(spark, sf_dir):
    return series.frame_log(complexity_series(spark, sf_dir))


@query()
def run_log(spark, sf_dir):
    return coding.run_log(blobs.benchmark(spark, sf_dir))
