"""Codecs: the registry, names of codec sets, and compression of blobs with verified round trips.

A codec that no installed library provides is listed with available = false and never replaced by another.
"""

from __future__ import annotations

import importlib.util
import re
import time

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streamloom.sources.streams import spread

# fixed values: name; version; first level; last level; parameter; threading
REGISTRY = """
memcpy;memcpy;0;0;0;BENCH_POOL_MT
aceapex;aceapex 1.0.1;1;2;0;FULL_THREADING
aceapex_cuda;aceapex_cuda 0.9;1;2;0;NO_THREADING
brieflz;brieflz 1.3.0;1;9;0;BENCH_POOL_MT
brotli;brotli 1.2.0;0;11;0;BENCH_POOL_MT
brotli22;brotli 1.2.0 -d22;0;11;22;BENCH_POOL_MT
brotli24;brotli 1.2.0 -d24;0;11;24;BENCH_POOL_MT
bsc0;bsc 3.3.12 -m0 -e2;0;0;0;BSC_THREADING
bsc1;bsc 3.3.12 -m0 -e1;0;0;1;BSC_THREADING
bsc2;bsc 3.3.12 -m0 -e0;0;0;2;BSC_THREADING
bsc3;bsc 3.3.12 -m3 -e1;0;0;3;BSC_THREADING
bsc4;bsc 3.3.12 -m4 -e1;0;0;4;BSC_THREADING
bsc5;bsc 3.3.12 -m5 -e1;0;0;5;BSC_THREADING
bsc6;bsc 3.3.12 -m6 -e1;0;0;6;BSC_THREADING
bsc_cuda0;bsc 3.3.12 -G -m0 -e2;0;0;0;BENCH_POOL_MT
bsc_cuda1;bsc 3.3.12 -G -m0 -e1;0;0;1;BENCH_POOL_MT
bsc_cuda2;bsc 3.3.12 -G -m0 -e0;0;0;2;BENCH_POOL_MT
bsc_cuda3;bsc 3.3.12 -G -m3 -e1;0;0;3;BENCH_POOL_MT
bsc_cuda4;bsc 3.3.12 -G -m4 -e1;0;0;4;BENCH_POOL_MT
bsc_cuda5;bsc 3.3.12 -G -m5 -e1;0;0;5;BENCH_POOL_MT
bsc_cuda6;bsc 3.3.12 -G -m6 -e1;0;0;6;BENCH_POOL_MT
bsc_cuda7;bsc 3.3.12 -G -m7 -e0;0;0;7;BENCH_POOL_MT
bsc_cuda8;bsc 3.3.12 -G -m8 -e0;0;0;8;BENCH_POOL_MT
bzip2;bzip2 1.0.8;1;9;0;BENCH_POOL_MT
bzip3;bzip3 1.5.3;1;10;0;BENCH_POOL_MT
crush;crush 1.0;0;2;0;NO_THREADING
csc;csc 2016-10-13;1;5;0;BENCH_POOL_MT
cudaMemcpy;cudaMemcpy;0;0;0;BENCH_POOL_MT
density;density 0.16.6;1;3;0;BENCH_POOL_MT
fastlz;fastlz 0.5.0;1;2;0;BENCH_POOL_MT
fastlzma2;fastlzma2 1.0.1;1;10;0;FULL_THREADING
gipfeli;gipfeli 2016-07-13;0;0;0;BENCH_POOL_MT
glza;glza 0.12;0;0;0;NO_THREADING
gpucompact;gpucompact 1.0;1;5;0;NO_THREADING
kanzi;kanzi 2.5.3;1;9;0;FULL_THREADING
libdeflate;libdeflate 1.25;1;12;0;BENCH_POOL_MT
lizard;lizard 2.1;10;49;0;BENCH_POOL_MT
lz4;lz4 1.10.0;0;0;0;BENCH_POOL_MT
lz4fast;lz4 1.10.0 --fast;1;99;0;BENCH_POOL_MT
lz4hc;lz4hc 1.10.0;1;12;0;BENCH_POOL_MT
lzav;lzav 5.16;1;2;0;BENCH_POOL_MT
lzf;lzf 3.6;0;1;0;BENCH_POOL_MT
lzfse;lzfse 2017-03-08;0;0;0;BENCH_POOL_MT
lzg;lzg 1.0.10;1;9;0;BENCH_POOL_MT
lzham;lzham 1.0 -d26;0;4;0;FULL_THREADING
lzham22;lzham 1.0 -d22;0;4;22;FULL_THREADING
lzham24;lzham 1.0 -d24;0;4;24;FULL_THREADING
lzjb;lzjb 2010;0;0;0;BENCH_POOL_MT
lzlib;lzlib 1.16;0;9;0;BENCH_POOL_MT
lzma;lzma 26.01;0;9;0;FULL_THREADING
lzmat;lzmat 1.01;0;0;0;BENCH_POOL_MT
lzo1;lzo1 2.10;1;99;0;BENCH_POOL_MT
lzo1a;lzo1a 2.10;1;99;0;BENCH_POOL_MT
lzo1b;lzo1b 2.10;1;999;0;BENCH_POOL_MT
lzo1c;lzo1c 2.10;1;999;0;BENCH_POOL_MT
lzo1f;lzof 2.10;1;999;0;BENCH_POOL_MT
lzo1x;lzo1x 2.10;1;999;0;BENCH_POOL_MT
lzo1y;lzo1y 2.10;1;999;0;BENCH_POOL_MT
lzo1z;lzo1z 2.10;999;999;0;BENCH_POOL_MT
lzo2a;lzo2a 2.10;999;999;0;BENCH_POOL_MT
lzrw;lzrw 15-Jul-1991;1;5;0;BENCH_POOL_MT
lzsse2;lzsse2 2019-04-18;0;17;0;BENCH_POOL_MT
lzsse4;lzsse4 2019-04-18;0;17;0;BENCH_POOL_MT
lzsse4fast;lzsse4fast 2019-04-18;0;0;0;BENCH_POOL_MT
lzsse8;lzsse8 2019-04-18;0;17;0;BENCH_POOL_MT
lzsse8fast;lzsse8fast 2019-04-18;0;0;0;BENCH_POOL_MT
lzvn;lzvn 2017-03-08;0;0;0;BENCH_POOL_MT
memlz;memlz 0.2 beta;0;0;0;BENCH_POOL_MT
misa77;misa77 0.6.0;-1;4;0;BENCH_POOL_MT
misa77_safe;misa77 0.6.0 safe;-1;3;0;BENCH_POOL_MT
nvcomp_lz4;nvcomp_lz4 2.2.0;0;7;0;BENCH_POOL_MT
openzl_u8;openzl 0.2.3 -p u8;0;0;0;BENCH_POOL_MT
openzl_i8;openzl 0.2.3 -p i8;0;0;0;BENCH_POOL_MT
openzl_le_u16;openzl 0.2.3 -p le-u16;0;0;0;BENCH_POOL_MT
openzl_le_i16;openzl 0.2.3 -p le-i16;0;0;0;BENCH_POOL_MT
openzl_le_u32;openzl 0.2.3 -p le-u32;0;0;0;BENCH_POOL_MT
openzl_le_i32;openzl 0.2.3 -p le-i32;0;0;0;BENCH_POOL_MT
openzl_le_u64;openzl 0.2.3 -p le-u64;0;0;0;BENCH_POOL_MT
openzl_le_i64;openzl 0.2.3 -p le-i64;0;0;0;BENCH_POOL_MT
openzl_serial;openzl 0.2.3 -p serial;0;0;0;BENCH_POOL_MT
openzl_generic;openzl 0.2.3 'generic';0;0;0;BENCH_POOL_MT
openzl_zstd;openzl 0.2.3 'zstd';-99;22;0;BENCH_POOL_MT
openzl_lz4;openzl 0.2.3 'lz4';-99;12;0;BENCH_POOL_MT
ppmd8;ppmd8 26.01;1;9;0;BENCH_POOL_MT
quicklz;quicklz 1.5.1 beta 7;1;3;0;BENCH_POOL_MT
skim;skim 0.1.0;0;0;0;BENCH_POOL_MT
slz_deflate;slz_deflate 1.2.2;1;3;2;BENCH_POOL_MT
slz_gzip;slz_gzip 1.2.2;1;3;1;BENCH_POOL_MT
slz_zlib;slz_zlib 1.2.2;1;3;0;BENCH_POOL_MT
snappy;snappy 1.2.2;0;0;0;BENCH_POOL_MT
tamp;tamp 2.2.4;8;15;0;BENCH_POOL_MT
tornado;tornado 0.6a;1;16;0;NO_THREADING
ucl_nrv2b;ucl_nrv2b 1.03;1;9;0;BENCH_POOL_MT
ucl_nrv2d;ucl_nrv2d 1.03;1;9;0;BENCH_POOL_MT
ucl_nrv2e;ucl_nrv2e 1.03;1;9;0;BENCH_POOL_MT
wflz;wflz 2015-09-16;0;0;0;BENCH_POOL_MT
xz;xz 5.8.3;0;9;0;FULL_THREADING
yalz77;yalz77 2015-09-19;1;12;0;BENCH_POOL_MT
yappy;yappy 2014-03-22;1;12;0;NO_THREADING
zlib;zlib 1.3.2;1;9;0;BENCH_POOL_MT
zlib-ng;zlib-ng 2.3.3;1;9;0;BENCH_POOL_MT
zling;zling 2018-10-12;0;4;0;BENCH_POOL_MT
zpaq;zpaq 7.15;1;5;0;BENCH_POOL_MT
zstd;zstd 1.5.7;1;22;0;FULL_THREADING
zstd22;zstd 1.5.7 -d22;16;22;22;FULL_THREADING
zstd22LDM;zstd 1.5.7 --long -d22;16;22;22;FULL_THREADING
zstd24;zstd 1.5.7 -d24;16;22;24;FULL_THREADING
zstd24LDM;zstd 1.5.7 --long -d24;16;22;24;FULL_THREADING
zstdLDM;zstd 1.5.7 --long;1;22;0;FULL_THREADING
zstd_fast;zstd 1.5.7 --fast;-5;-1;0;FULL_THREADING
zxc;zxc 0.13.2;1;7;0;BENCH_POOL_MT
"""

# fixed values: names of codec sets, and the default levels of single codecs (lower case)
ALIASES = {
    "FAST": "memcpy/density,1,2,3/fastlz/kanzi,1,2,3/lizard,10,11,12,13,14/lz4/lz4fast,3,17/lzav/lzf/lzfse/lzo1b,1/lzo1c,1/lzo1f,1/lzo1x,1/lzo1y,1/lzsse4fast/lzsse8,1/lzvn/quicklz,1,2/skim/snappy/yalz77,1/zstd,1,2,3,4,5",
    "LZ": "memcpy/aceapex,1,2/brieflz,1,3,6,8/brotli,0,2,5,8,11/fastlz,1,2/fastlzma2,1,3,5,8,10/kanzi,1,2,3,4/libdeflate,1,3,6,9,12/lizard,10,12,15,19,20,22,25,29,30,32,35,39,40,42,45,49/lz4fast,17,9,3/lz4/lz4hc,1,4,9,12/lzav/lzf,0,1/lzfse/lzg,1,4,6,8/lzham,0,1/lzlib,0,3,6,9/lzma,0,2,4,6,9/lzo1/lzo1a/lzo1b,1,3,6,9,99,999/lzo1c,1,3,6,9,99,999/lzo1f/lzo1x/lzo1y/lzo1z/lzo2a/lzsse2,1,6,12,16/lzsse4fast/lzsse4,1,6,12,16/lzsse8,1,6,12,16/lzvn/memlz/misa77,-1,0,1,2,3,4/misa77_safe,-1,0,1,2,3/quicklz,1,2,3/slz_gzip/snappy/ucl_nrv2b,1,6,9/ucl_nrv2d,1,6,9/ucl_nrv2e,1,6,9/xz,1,3,5,7,9/yalz77,1,6,12/zlib,1,6,9/zlib-ng,1,6,9/zstd_fast,-5,-3,-1/zstd,1,2,5,8,11,15,18,22/zxc,1,3,6",
    "SYMMETRIC": "memcpy/bsc1/bsc4/bsc5/bzip2,1,5,9/bzip3,1,5,9/density,1,2,3/kanzi,5,6,7,8,9/ppmd8,1,4,9/zpaq,1,5",
    "MISC": "memcpy/crush,0,2/lzjb/skim/tamp,8,12,15/tornado,1,6,11,16/zling,0,2,4",
    "ALL": "LZ/SYMMETRIC/MISC",
    "FASTEST": "memcpy/aceapex,1/brieflz,1/brotli,0/fastlz,1/fastlzma2,1/kanzi,1/libdeflate,1/lizard,10/lz4fast,99/lz4/lz4hc,1/lzav,1/lzf,0/lzfse/lzham,0/lzlib,0/lzma,0/lzo1,1/lzo1a,1/lzo1b,1/lzo1c,1/lzo1f,1/lzo1x,1/lzo1y,1/lzo1z/lzo2a/lzsse2,1/lzsse4fast/lzsse4,1/lzsse8,1/lzvn/memlz/misa77,0/misa77_safe,0/quicklz,1/slz_gzip,1/snappy/ucl_nrv2b,1/ucl_nrv2d,1/ucl_nrv2e,1/xz,0/yalz77,1/zlib,1/zlib-ng,1/zstd_fast,-5/zstd,1/zxc,1/bsc1/bzip2,1/bzip3,1/density,1/ppmd8,1/zpaq,1/crush,0/lzjb/skim/tamp,8/tornado-DISABLED,1/zling,0",
    "SLOW": "memcpy/glza",
    "BUGGY": "memcpy/csc/gipfeli/lzmat/lzrw/lzsse8fast/wflz/yappy",
    "POPULAR": "memcpy/brotli,0,2,5,8,11/bzip2,1,5,9/bzip3,5/kanzi,1,2,3,4,5,6,7,8,9/libdeflate,1,3,6,9,12/lz4fast,17,9,3/lz4/lz4hc,1,4,9,12/lzlib,0,3,6,9/lzma,0,2,4,6,9/ppmd8,4/snappy/xz,1,3,5,7,9/zlib,1,6,9/zlib-ng,1,6,9/zstd_fast,-5,-3,-1/zstd,1,2,5,8,11,15,18,22",
    "MAINSTREAM": "memcpy/lz4fast,17,9,5/lz4/lz4hc,1,3,9/zstd_fast,-5,-3,-1/zstd,1,3,7,12,17,22/zlib,1,6,9/lzma,0,4,9/bzip2,1,9/ppmd8,4",
    "INT_MT": "memcpy/bsc0/bsc1/bsc4/bsc5/bsc6/fastlzma2,1,5,10/kanzi,1,2,3,4,5,6,7/lzham,1,4/lzma,0,4,9/xz,0,4,9/zstd,1,5,9,14,18,22",
    "OPT": "memcpy/brotli,6,7,8,9,10,11/fastlzma2,1,2,3,4,5,6,7,8,9,10/lzham,0,1,2,3,4/lzlib,0,1,2,3,4,5,6,7,8,9/lzma,0,1,2,3,4,5,6,7,8,9/xz,1,2,3,4,5,6,7,8,9/zstd,18,19,20,21,22",
    "UCL": "ucl_nrv2b/ucl_nrv2d/ucl_nrv2e",
    "LZO": "lzo1/lzo1a/lzo1b/lzo1c/lzo1f/lzo1x/lzo1y/lzo1z/lzo2a",
    "OPENZL": "openzl_u8/openzl_i8/openzl_le_u16/openzl_le_i16/openzl_le_u32/openzl_le_i32/openzl_le_u64/openzl_le_i64/openzl_serial/openzl_generic/openzl_zstd/openzl_lz4",
    "BSC": "bsc0/bsc1/bsc2/bsc3/bsc4/bsc5/bsc6",
    "BSC_CUDA": "bsc_cuda0/bsc_cuda1/bsc_cuda2/bsc_cuda3/bsc_cuda4/bsc_cuda5/bsc_cuda6/bsc_cuda7/bsc_cuda8",
    "CUDA": "memcpy/cudaMemcpy/nvcomp_lz4/bsc_cuda/aceapex_cuda/gpucompact",
    "lzo1": "lzo1,1,99",
    "lzo1a": "lzo1a,1,99",
    "lzo1b": "lzo1b,1,2,3,4,5,6,7,8,9,99,999",
    "lzo1c": "lzo1c,1,2,3,4,5,6,7,8,9,99,999",
    "lzo1f": "lzo1f,1,999",
    "lzo1x": "lzo1x,1,11,12,15,999",
    "lzo1y": "lzo1y,1,999",
    "openzl_zstd": "openzl_zstd,-99,-90,-80,-70,-60,-50,-40,-30,-20,-10,-8,-6,-5,-4,-3,-2,-1,1,2,3,4,5,6,8,10,12,14,16,18,20,22",
    "openzl_lz4": "openzl_lz4,-99,-90,-80,-70,-60,-50,-40,-30,-20,-10,-8,-6,-5,-4,-3,-2,-1,1,2,3,4,5,6,7,8,9,10,11,12",
}

#: memory bound of a compressed block
BOUND = "size + size div 8 + 1024"


def bindings() -> dict:
    """name -> (compress(bytes, level), decompress(bytes, size)) of the codecs that libraries here provide."""
    import bz2
    import lzma
    import zlib

    def arrow(kind, levels=True):
        return (lambda b, level: bytes(pa.Codec(kind, level if levels else None).compress(b))), (lambda c, n: bytes(pa.Codec(kind).decompress(c, n)))

    def deflate(b, level):
        z = zlib.compressobj(min(level, 9), zlib.DEFLATED, -15)
        return z.compress(b) + z.flush()

    def zstd(window=0, far=False):
        """Of a window (its logarithm; 0: that of the level), with matching over long distances where far says so."""
        import zstandard

        if window or far:
            extra = {"enable_ldm": far} | ({"window_log": window} if window else {})
            make = lambda level: zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters.from_level(level, **extra))
            return (lambda b, level: make(level).compress(b)), (lambda c, n: zstandard.ZstdDecompressor(max_window_size=1 << 31).decompress(c, max_output_size=max(n, 1)))
        return (lambda b, level: zstandard.ZstdCompressor(level=level).compress(b)), (lambda c, n: zstandard.ZstdDecompressor().decompress(c, max_output_size=max(n, 1)))

    out = {
        "memcpy": (lambda b, level: bytes(b), lambda c, n: bytes(c)),
        "bzip2": (lambda b, level: bz2.compress(b, level), lambda c, n: bz2.decompress(c)),
        "zlib": (lambda b, level: zlib.compress(b, level), lambda c, n: zlib.decompress(c)),
        "libdeflate": (deflate, lambda c, n: zlib.decompress(c, -15)),
        "lzma": (lambda b, level: lzma.compress(b, lzma.FORMAT_ALONE, preset=level), lambda c, n: lzma.decompress(c)),
        "xz": (lambda b, level: lzma.compress(b, preset=level), lambda c, n: lzma.decompress(c)),
        "brotli": arrow("brotli"),
        "snappy": arrow("snappy", levels=False),
        "lz4": arrow("lz4_raw", levels=False),
    }
    # the library's own high-compression levels (frames), as its levels from 3 on are
    out["lz4hc"] = (lambda b, level: bytes(pa.Codec("lz4", max(level, 3)).compress(b))), (lambda c, n: bytes(pa.Codec("lz4").decompress(c, n)))
    if importlib.util.find_spec("zstandard"):
        out["zstd"] = out["zstd_fast"] = zstd()
        for name, window, far in (("zstd22", 22, False), ("zstd22LDM", 22, True), ("zstd24", 24, False), ("zstd24LDM", 24, True), ("zstdLDM", 0, True)):
            out[name] = zstd(window, far)
    return out


def registry(spark: SparkSession) -> DataFrame:
    """name, version, first_level, last_level, param, mt_mode, available."""
    have = bindings()
    rows = [line.split(";") for line in REGISTRY.strip().split("\n")]
    return spark.createDataFrame([(n, v, int(a), int(b), int(p), t, n in have) for n, v, a, b, p, t in rows], "name string, version string, first_level int, last_level int, param int, mt_mode string, available boolean")


def levels() -> dict[str, tuple[int, int]]:
    return {x[0]: (int(x[2]), int(x[3])) for x in (line.split(";") for line in REGISTRY.strip().split("\n"))}


def expand(spec: str, depth: int = 0) -> list[tuple[str, int]]:
    """(codec, level) of a list "name,level,level/name/...": a set's name stands for its members, a codec without levels for all
    of its levels (or its own default list), and "name,A-B" for a range of levels."""
    if depth > 8:
        raise ValueError("sets name each other")
    out: list[tuple[str, int]] = []
    known = levels()
    for part in filter(None, spec.split("/")):
        name, *given = part.split(",")
        if name in ALIASES and not given and (name.isupper() or depth == 0 or name not in known) and ALIASES[name] != part:
            out += expand(ALIASES[name], depth + 1)
        elif name in known:
            first, last = known[name]
            wanted = []
            for g in given:
                m = re.fullmatch(r"(-?\d+)-(-?\d+)", g)
                wanted += list(range(int(m[1]), int(m[2]) + 1)) if m else [int(g)]
            for level in wanted or range(first, last + 1):
                out.append((name, min(max(level, first), last)))
    return list(dict.fromkeys(out))


def jobs(spark: SparkSession, spec: str) -> DataFrame:
    """codec, level, job_no in the order of the list."""
    return spark.createDataFrame([(n, v, i) for i, (n, v) in enumerate(expand(spec))], "codec string, level int, job_no int")


def run(blobs: DataFrame, spec: str, repeats: int = 1) -> DataFrame:
    """A row for each blob (id, bytes) and available (codec, level) of the list: sizes, times in ns, whether the bytes came back."""
    have = bindings()
    todo = [(n, v) for n, v in expand(spec) if n in have]

    def each(batches):
        found = bindings()
        for b in batches:
            rows = []
            for key, data in zip(b.column("id").to_pylist(), b.column("bytes").to_pylist()):
                data = data or b""
                for name, level in todo:
                    pack, unpack = found[name]
                    for i in range(repeats):
                        t0 = time.perf_counter_ns()
                        packed = pack(data, level)
                        t1 = time.perf_counter_ns()
                        back = unpack(packed, len(data))
                        t2 = time.perf_counter_ns()
                        rows.append((key, name, level, i, len(data), len(packed), t1 - t0, t2 - t1, back == data))
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 9, kinds)], names=["id", "codec", "level", "iteration", "origsize", "comprsize", "ctime", "dtime", "restored"])

    rows = blobs.select(F.col("id").cast("long"), F.col("bytes").cast("binary"))
    return spread(rows, "id", "bytes").mapInArrow(each, "id long, codec string, level int, iteration int, origsize long, comprsize long, ctime long, dtime long, restored boolean")


def summarize(results: DataFrame, time_type: str = "fastest") -> DataFrame:
    """Totals of each codec and level: per blob the fastest, average or median iteration, then sums."""
    take = {"fastest": F.min, "average": F.avg, "median": F.median}[time_type]
    per = results.groupBy("id", "codec", "level").agg(take("ctime").alias("ctime"), take("dtime").alias("dtime"), F.first("origsize").alias("origsize"), F.first("comprsize").alias("comprsize"), F.bool_and("restored").alias("restored"))
    out = per.groupBy("codec", "level").agg(F.sum("ctime").cast("long").alias("ctime"), F.sum("dtime").cast("long").alias("dtime"), F.sum("comprsize").alias("comprsize"), F.sum("origsize").alias("origsize"), F.bool_and("restored").alias("restored"))
    ratio = F.when(F.col("origsize") > 0, F.round(100.0 * F.col("comprsize") / F.col("origsize"), 2))
    speed = lambda t: F.when(F.col(t) > 0, F.col("origsize") * 1000.0 / F.col(t))
    return out.withColumn("ratio", ratio).withColumn("cspeed", speed("ctime")).withColumn("dspeed", speed("dtime"))


def order_of(column: int) -> list:
    """Column 1 name, 2 compression time and 3 decompression time (both falling), 4 compressed size, 5 original size."""
    return [{1: F.col("algname"), 2: F.desc("ctime"), 3: F.desc("dtime"), 4: F.col("comprsize"), 5: F.col("origsize")}[column], F.col("algname")]


def ordered(results: DataFrame, column: int) -> DataFrame:
    return results.orderBy(*order_of(column))


def ranked(results: DataFrame, column: int) -> DataFrame:
    """The results with their place in that order. Results are a row for each codec and level, so one window holds them."""
    return results.select(F.row_number().over(Window.orderBy(*order_of(column))).cast("long").alias("place"), "*")


def rendered(results: DataFrame, style: str) -> DataFrame:
    """Result rows as lines of text: text, csv or markdown."""
    cols = ["algname", "ctime", "dtime", "comprsize", "origsize"]
    if style == "csv":
        return results.select(F.concat_ws(",", *cols).alias("line"))
    if style == "markdown":
        return results.select(F.format_string("| %s | %d | %d | %d | %d |", *cols).alias("line"))
    return results.select(F.format_string("%-20s %12d %12d %12d %12d", *cols).alias("line"))
