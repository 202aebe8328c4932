"""GeoTIFF files as tables: their headers, their blocks (strips or tiles) still packed, and the pixels of the blocks that are wanted.

Plain and big files, either byte order; plain, LZW, deflated and PackBits blocks; the predictors for whole and for floating
numbers; the first band. A file is cut into its blocks without unpacking them, one row each, so that the blocks of a large file
are spread over tasks, and `values_at` joins them with the wanted pixels first: a block without one is never unpacked. `tiles`
writes pixels as files of one tile each.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rasters import Raster, cleaned, projected

#: Bytes of a field by its type, and the tags that are read.
FIELD_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
FIELD_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
TAGS = {
    256: "cols", 257: "rows", 258: "bits", 259: "compression", 273: "offsets", 277: "samples", 278: "strip_rows", 279: "sizes", 284: "planar", 317: "predictor",
    322: "tile_cols", 323: "tile_rows", 324: "offsets", 325: "sizes", 339: "format", 33550: "scale", 33922: "tie", 34735: "geo_keys", 42113: "nodata",
}
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
HEADERS = "path string, west double, north double, pixel_width double, pixel_height double, rows int, cols int, nodata double, crs string"
BLOCK_SIZE = "block_rows int, block_cols int"
BLOCKS = "path string, block int, row int, col int, rows int, cols int, width int, samples int, dtype string, compression int, predictor int, data binary"
PIXELS = "path string, row int, col int, value double"


def tags_of(raw: bytes) -> tuple[str, dict]:
    """(byte order, tags by name) of a file's first image; plain files number their bytes by 32 bits, big ones by 64."""
    try:
        return _tags(raw)
    except struct.error as e:
        raise ValueError("the TIFF file is cut short") from e


def _tags(raw: bytes) -> tuple[str, dict]:
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    version = struct.unpack(order + "H", raw[2:4])[0] if order and len(raw) >= 16 else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    count, place, head = ("H", "I", 4) if version == 42 else ("Q", "Q", 8)
    width = struct.calcsize(place)
    at = struct.unpack(order + place, raw[head : head + width])[0]
    entries, out = struct.unpack(order + count, raw[at : at + struct.calcsize(count)])[0], {}
    at += struct.calcsize(count)
    for k in range(entries):
        entry = at + (4 + 2 * width) * k
        tag, kind, n = struct.unpack(order + "HH" + place, raw[entry : entry + 4 + width])
        if tag not in TAGS or kind not in FIELD_BYTES:
            continue
        size, value = FIELD_BYTES[kind] * n, entry + 4 + width
        value = value if size <= width else struct.unpack(order + place, raw[value : value + width])[0]
        data = raw[value : value + size]
        if len(data) < size:
            raise ValueError("the TIFF file is cut short")
        if kind == 2:
            out[TAGS[tag]] = data.rstrip(b"\0").decode("ascii")
        elif kind in FIELD_CODES:
            out[TAGS[tag]] = struct.unpack(f"{order}{n}{FIELD_CODES[kind]}", data)
    return order, out


def block_size(t: dict) -> tuple[int, int]:
    """Rows and columns of a block, by the tags."""
    if "tile_cols" in t:
        return t["tile_rows"][0], t["tile_cols"][0]
    return min(t.get("strip_rows", t["rows"])[0], t["rows"][0]), t["cols"][0]


def header_of(raw: bytes) -> Raster:
    """Where the image lies: from its pixel scale and its first tie point."""
    return _raster(tags_of(raw)[1])


def _raster(t: dict) -> Raster:
    if "scale" not in t or "tie" not in t:
        raise ValueError("the TIFF file doesn't say where it lies")
    sx, sy = t["scale"][:2]
    i, j, _, x, y, _ = t["tie"][:6]
    keys = t.get("geo_keys", ())
    codes = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4)}
    code = codes.get(3072) or codes.get(2048) or 4326
    nodata = float(t["nodata"]) if t.get("nodata", "").strip() else None
    return Raster(x - i * sx, y + j * sy, sx, sy, t["rows"][0], t["cols"][0], nodata, f"EPSG:{code}")


def packed_blocks(raw: bytes) -> Iterator[tuple]:
    """The columns of BLOCKS behind path, for each strip or tile of the first band."""
    order, t = tags_of(raw)
    rows, cols, samples = t["rows"][0], t["cols"][0], t.get("samples", (1,))[0]
    bits, kind, packing, predictor = t.get("bits", (1,))[0], t.get("format", (1,))[0], t.get("compression", (1,))[0], t.get("predictor", (1,))[0]
    known = packing in (PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS) and predictor in (1, 2, 3) and kind in (1, 2, 3) and bits in (8, 16, 32, 64)
    if not known or (predictor == 3) > (kind == 3) or (kind == 3 and bits == 8):
        raise ValueError(f"compression {packing} with predictor {predictor}, format {kind} and {bits} bits is not supported")
    apart = samples > 1 and t.get("planar", (1,))[0] == 2
    high, wide = block_size(t)
    across, down = -(-cols // wide), -(-rows // high)
    for k in range(across * down):  # with bands apart, the first band's blocks come first
        r, c = k // across * high, k % across * wide
        data = raw[t["offsets"][k] : t["offsets"][k] + t["sizes"][k]]
        yield k, r, c, min(high, rows - r), min(wide, cols - c), wide, 1 if apart else samples, f"{order}{'uif'[kind - 1]}{bits // 8}", packing, predictor, data


def unpacked_lzw(data: bytes) -> bytes:
    """LZW as TIFF writes it: codes of 9 to 12 bits from the highest bit on, 256 starts again, 257 ends, widths grow one code early."""
    out, table, last = [], [], None
    buffer = bits = at = 0
    width = 9
    while True:
        while bits < width:
            if at >= len(data):
                return b"".join(out)
            buffer, bits, at = (buffer << 8 | data[at]) & 0xFFFFFF, bits + 8, at + 1
        bits -= width
        code = buffer >> bits & ((1 << width) - 1)
        if code == 257:
            return b"".join(out)
        if code == 256:
            table, last, width = [bytes([k]) for k in range(256)] + [b"", b""], None, 9
            continue
        if last is None:
            table = table or [bytes([k]) for k in range(256)] + [b"", b""]
            found = table[code]
        else:
            if code > len(table):
                raise ValueError("an LZW block is damaged")
            found = table[code] if code < len(table) else last + last[:1]
            table.append(last + found[:1])
        out.append(found)
        last = found
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12


def unpacked_bits(data: bytes) -> bytes:
    """PackBits: a count from 0 to 127 for so many bytes and one as they stand, a negative one for a byte repeated."""
    out, at = [], 0
    while at < len(data):
        n, at = data[at], at + 1
        if n < 128:
            out.append(data[at : at + n + 1])
            at += n + 1
        elif n > 128:
            out.append(data[at : at + 1] * (257 - n))
            at += 1
    return b"".join(out)


def unpacked(rows: int, cols: int, width: int, samples: int, dtype: str, compression: int, predictor: int, data: bytes) -> np.ndarray:
    """The values of a block's first band."""
    if compression != PLAIN:
        data = {LZW: unpacked_lzw, PACKBITS: unpacked_bits}.get(compression, zlib.decompress)(data)
    kind, line = np.dtype(dtype), width * samples
    lines = len(data) // (line * kind.itemsize)
    if lines < rows:
        raise ValueError("a block of the TIFF file is cut short")
    data = data[: lines * line * kind.itemsize]
    if predictor == 3:  # bytes of a line by their weight, the highest first, each a difference
        b = np.cumsum(np.frombuffer(data, np.uint8).reshape(lines, -1, samples), axis=1, dtype=np.uint8)
        v = np.ascontiguousarray(b.reshape(lines, kind.itemsize, line).transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(lines, width, samples)
    else:
        v = np.frombuffer(data, kind).reshape(lines, width, samples)
        v = np.cumsum(v, axis=1, dtype=kind.newbyteorder("=")) if predictor == 2 else v
    return v[:rows, :cols, 0]


def blocks_of(raw: bytes) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, first column, values) of each strip or tile of the first band."""
    for _, r, c, *how in packed_blocks(raw):
        yield r, c, unpacked(*how)


def files_at(spark: SparkSession, path: str) -> DataFrame:
    """path and content of the files under a path."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


_KINDS = {"double": pa.float64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*[c.strip().split(" ") for c in schema.split(",")], strict=True)
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(columns, kinds, strict=True)], list(names))


def headers_of(files: DataFrame) -> DataFrame:
    """One row per file of (path, content): path, west, north, pixel_width, pixel_height, rows, cols, nodata, crs, block_rows, block_cols."""
    schema = f"{HEADERS}, {BLOCK_SIZE}"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                t = tags_of(b.column(1)[k].as_py())[1]
                r = _raster(t)
                yield _batch([(b.column(0)[k].as_py(), r.west, r.north, r.pixel_width, r.pixel_height, r.rows, r.cols, r.nodata, r.crs, *block_size(t))], schema)

    return files.select("path", "content").mapInArrow(read, schema)


def blocks(files: DataFrame) -> DataFrame:
    """One row per block of (path, content) files, packed as it is in the file."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                name = b.column(0)[k].as_py()
                for block in packed_blocks(b.column(1)[k].as_py()):
                    yield _batch([(name, *block)], BLOCKS)

    return files.select("path", "content").mapInArrow(read, BLOCKS)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """The headers of all files under a path."""
    return headers_of(files_at(spark, path))


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The packed blocks of all files under a path."""
    return blocks(files_at(spark, path))


def pixels_of(packed: DataFrame) -> DataFrame:
    """(path, row, col, value) of every pixel of the blocks."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                name, _, r, c, *how = (x[k].as_py() for x in b.columns)
                v = unpacked(*how)
                row, col = np.indices(v.shape, np.int32)
                columns = [pa.array([name] * v.size, pa.string()), pa.array(row.ravel() + np.int32(r)), pa.array(col.ravel() + np.int32(c)), pa.array(v.ravel().astype(np.float64))]
                yield pa.RecordBatch.from_arrays(columns, ["path", "row", "col", "value"])

    return packed.mapInArrow(read, PIXELS)


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, col, value) of all files' first bands, for those who want every pixel."""
    return pixels_of(read_blocks(spark, path))


def wanted_blocks(places: DataFrame, packed: DataFrame, headers: DataFrame) -> DataFrame:
    """The packed blocks in which places (path, row, col) lie, each once, with `pixels`: the distinct ones in it, as row * width + column within the block.

    Only these are unpacked; a block's pixels bound the list.
    """
    size = headers.select("path", "block_rows", "block_cols", F.ceil(F.col("cols") / F.col("block_cols")).cast("int").alias("across"))
    at = places.select("path", "row", "col").join(size, "path")
    block = (F.expr("row div block_rows") * F.col("across") + F.expr("col div block_cols")).cast("int")
    pixel = ((F.col("row") % F.col("block_rows")) * F.col("block_cols") + F.col("col") % F.col("block_cols")).cast("int")
    wanted = at.select("path", block.alias("block"), pixel.alias("pixel")).groupBy("path", "block").agg(F.collect_set("pixel").alias("pixels"))
    return packed.join(wanted, ["path", "block"])


def values_at(places: DataFrame, packed: DataFrame, headers: DataFrame) -> DataFrame:
    """(path, row, col, value) of the distinct places (path, row, col) that lie in the files' blocks."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                name, _, r, c, *how, pixels = (x[k].as_py() for x in b.columns)
                v, width = unpacked(*how), how[2]
                row, col = np.divmod(np.array(pixels, np.int64), width)
                ok = (row < v.shape[0]) & (col < v.shape[1])
                row, col = row[ok].astype(np.int32), col[ok].astype(np.int32)
                columns = [pa.array([name] * len(row), pa.string()), pa.array(row + np.int32(r)), pa.array(col + np.int32(c)), pa.array(v[row, col].astype(np.float64))]
                yield pa.RecordBatch.from_arrays(columns, ["path", "row", "col", "value"])

    names = [c.strip().split(" ")[0] for c in BLOCKS.split(",")]
    return wanted_blocks(places, packed, headers).select(*names, "pixels").mapInArrow(read, PIXELS)


def sample_files(files: DataFrame, zones: DataFrame, key: str, tid: int = 0) -> DataFrame:
    """Cell objects (dggid, tid, attr_key, value_num): the pixel of (path, content) files at each zone's centre (dggid, lon, lat).

    Each file is read in its own reference system. No data and values that aren't finite go; where files overlap, the one with
    the greatest path stays. The few headers are joined with the zones by where they lie; of the files, only the blocks with a
    zone's centre are unpacked.
    """
    headers = headers_of(files)
    systems = [r.crs for r in headers.select("crs").distinct().limit(MOST_SYSTEMS + 1).collect()]
    if len(systems) > MOST_SYSTEMS:
        raise ValueError(f"more than {MOST_SYSTEMS} reference systems")
    points = None
    for crs in systems:
        x, y = projected(F.col("lon"), F.col("lat"), crs)
        one = zones.select("dggid", F.lit(crs).alias("crs"), x.alias("x"), y.alias("y"))
        points = one if points is None else points.unionByName(one)
    if points is None:
        return zones.select("dggid", F.lit(tid).cast("bigint").alias("tid"), F.lit(key).alias("attr_key"), F.lit(None).cast("double").alias("value_num")).limit(0)
    # files and points meet in squares of the size of the largest file: each point in its own, each file in the at most four that it touches
    side = headers.groupBy("crs").agg(F.max(F.greatest(F.col("cols") * F.col("pixel_width"), F.col("rows") * F.col("pixel_height"))).alias("side"))
    h = headers.join(side, "crs").withColumn("east", F.col("west") + F.col("cols") * F.col("pixel_width")).withColumn("south", F.col("north") - F.col("rows") * F.col("pixel_height"))
    square = lambda v: F.floor(F.col(v) / F.col("side"))
    h = h.withColumn("sx", F.explode(F.sequence(square("west"), square("east")))).withColumn("sy", F.explode(F.sequence(square("south"), square("north"))))
    p = points.join(side, "crs").withColumn("sx", square("x")).withColumn("sy", square("y")).drop("side")
    row, col = F.floor((F.col("north") - F.col("y")) / F.col("pixel_height")), F.floor((F.col("x") - F.col("west")) / F.col("pixel_width"))
    at = p.join(h, ["crs", "sx", "sy"]).select("dggid", "path", "nodata", row.cast("int").alias("row"), col.cast("int").alias("col"), "rows", "cols")
    at = at.where((F.col("row") >= 0) & (F.col("col") >= 0) & (F.col("row") < F.col("rows")) & (F.col("col") < F.col("cols"))).drop("rows", "cols")
    found = cleaned(at.join(values_at(at, blocks(files), headers), ["path", "row", "col"]).withColumnRenamed("value", "value_num"))
    return found.groupBy("dggid").agg(F.max_by("value_num", "path").alias("value_num")).select("dggid", F.lit(tid).cast("bigint").alias("tid"), F.lit(key).alias("attr_key"), "value_num")


#: Reference systems that the files of one call may have: all of UTM's 120 zones and those in degrees.
MOST_SYSTEMS = 256


def packed_bits(data: bytes) -> bytes:
    """PackBits of some bytes: repeats of two and more as one, the others as they stand."""
    b = np.frombuffer(data, np.uint8)
    cuts = np.concatenate([[0], np.flatnonzero(b[1:] != b[:-1]) + 1, [len(b)]]).tolist() if len(b) else [0]
    out, single = [], b""
    for a, z in zip(cuts, cuts[1:], strict=False):
        while z - a >= 2:
            n = min(128, z - a)
            out += [bytes([len(single[k : k + 128]) - 1]) + single[k : k + 128] for k in range(0, len(single), 128)]
            single = b""
            out.append(bytes([257 - n]) + data[a : a + 1])
            a += n
        single += data[a:z]
    out += [bytes([len(single[k : k + 128]) - 1]) + single[k : k + 128] for k in range(0, len(single), 128)]
    return b"".join(out)


def packed_lzw(data: bytes) -> bytes:
    """LZW as `unpacked_lzw` reads it."""
    buffer, bits, out, width, table, word = 0, 0, bytearray(), 9, {bytes([k]): k for k in range(256)}, b""

    def put(code: int) -> None:
        nonlocal buffer, bits
        buffer, bits = buffer << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(buffer >> bits & 255)
        buffer &= (1 << bits) - 1

    put(256)
    size = 258
    for k in range(len(data)):
        more = word + data[k : k + 1]
        if more in table:
            word = more
            continue
        put(table[word])
        table[more] = size
        size, word = size + 1, data[k : k + 1]
        if size > 4094:
            put(256)
            table, size, width = {bytes([k]): k for k in range(256)}, 258, 9
        else:
            width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    if word:
        put(table[word])
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    put(257)
    return bytes(out) + (bytes([buffer << 8 - bits & 255]) if bits else b"")


def file_of(values: np.ndarray, raster: Raster, side: int = 256, compression: int = LZW, big: bool = False) -> bytes:
    """A file of one band in tiles of `side` pixels (a multiple of 16)."""
    v = np.ascontiguousarray(values, values.dtype.newbyteorder("<"))
    pack = {PLAIN: bytes, LZW: packed_lzw, PACKBITS: packed_bits, DEFLATE: zlib.compress}[compression]
    tiles_ = []
    for r in range(0, v.shape[0], side):
        for c in range(0, v.shape[1], side):
            tile = np.zeros((side, side), v.dtype)
            part = v[r : r + side, c : c + side]
            tile[: part.shape[0], : part.shape[1]] = part
            tiles_.append(pack(tile.tobytes()))
    code = int(raster.crs.rpartition(":")[2]) if raster.crs.startswith("EPSG:") else 4326
    degrees = raster.crs in ("EPSG:4326", "OGC:CRS84")
    place = "Q" if big else "I"
    kind = {"u": 1, "i": 2, "f": 3}[v.dtype.kind]
    tags = [
        (256, 4, [v.shape[1]]), (257, 4, [v.shape[0]]), (258, 3, [8 * v.dtype.itemsize]), (259, 3, [compression]), (277, 3, [1]), (317, 3, [1]), (322, 3, [side]), (323, 3, [side]),
        (324, 16 if big else 4, None), (325, 16 if big else 4, [len(x) for x in tiles_]), (339, 3, [kind]), (33550, 12, [raster.pixel_width, raster.pixel_height, 0.0]),
        (33922, 12, [0.0, 0.0, 0.0, raster.west, raster.north, 0.0]), (34735, 3, [1, 1, 0, 1, 2048 if degrees else 3072, 0, 1, code]),
    ]
    if raster.nodata is not None:
        tags.append((42113, 2, f"{raster.nodata:g}".encode() + b"\0"))
    width, head = (8, 16) if big else (4, 8)
    room = lambda kind, x: FIELD_BYTES[kind] * len(tiles_ if x is None else x)
    first = head + (8 if big else 2) + len(tags) * (4 + 2 * width) + width
    body = first + sum(n for _, k, x in tags if (n := room(k, x)) > width)
    starts = [body + sum(len(x) for x in tiles_[:k]) for k in range(len(tiles_))]
    entries = data = b""
    for tag, field, x in tags:
        x = starts if x is None else x
        raw = x if field == 2 else struct.pack(f"<{len(x)}{FIELD_CODES[field]}", *x)
        entries += struct.pack(f"<HH{place}", tag, field, len(x)) + (raw.ljust(width, b"\0") if len(raw) <= width else struct.pack(f"<{place}", first + len(data)))
        data += raw if len(raw) > width else b""
    start = struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) + struct.pack("<Q", len(tags)) if big else struct.pack("<2sHIH", b"II", 42, 8, len(tags))
    return start + entries + b"\0" * width + data + b"".join(tiles_)


def tiles(pixels: DataFrame, raster: Raster, side: int = 256, compression: int = LZW, nodata: float = -9999.0, big: bool = False) -> DataFrame:
    """Pixels (row, col, value) as GeoTIFF files of one tile each: (path, content), paths `r<row>-c<col>.tif` by the tile's place.

    A tile's pixels bound what a task holds. Pixels outside the raster go, missing ones are no data; of several at one place the greatest stays.
    """
    def write(table: pa.Table) -> pa.Table:
        r, c = table["tr"][0].as_py(), table["tc"][0].as_py()
        shape = min(side, raster.rows - r * side), min(side, raster.cols - c * side)
        v = np.full(shape, nodata)
        row, col, value = (table[x].to_numpy() for x in ("row", "col", "value"))
        order = np.argsort(value, kind="stable")
        v[row[order] - r * side, col[order] - c * side] = value[order]
        at = Raster(raster.west + c * side * raster.pixel_width, raster.north - r * side * raster.pixel_height, raster.pixel_width, raster.pixel_height, *shape, nodata, raster.crs)
        small = 16 * math.ceil(max(shape) / 16)
        return pa.table({"path": [f"r{r}-c{c}.tif"], "content": pa.array([file_of(v, at, min(side, small), compression, big)], pa.binary())})

    p = pixels.select(F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), F.col("value").cast("double").alias("value")).where("value is not null")
    p = p.where((F.col("row") >= 0) & (F.col("row") < raster.rows) & (F.col("col") >= 0) & (F.col("col") < raster.cols))
    p = p.withColumn("tr", F.expr(f"row div {side}")).withColumn("tc", F.expr(f"col div {side}"))
    return p.groupBy("tr", "tc").applyInArrow(write, "path string, content binary")


def raster_of(headers: DataFrame) -> Raster:
    """The header of a single file."""
    r = headers.first()
    return Raster(r.west, r.north, r.pixel_width, r.pixel_height, r.rows, r.cols, r.nodata, r.crs)


def single(pixels: DataFrame, path: str) -> DataFrame:
    """The pixels of one file."""
    return pixels.where(F.col("path") == path)
